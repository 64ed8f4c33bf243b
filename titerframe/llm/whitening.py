"""Whitening of embeddings: principal components of fixed-point vectors, scaled to unit variance.

Sums and squared deviations are exact integers. The centred rows are a distributed matrix whose singular values MLlib
finds; those are rescaled to eigenvalues of the covariance with divisor n, and the total variance comes from the exact
deviations, not from the components.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove_scratch, table
from .vectors import matrix, usable

COMPONENTS = 32
#: Entries become floor(SCALE * c) + SHIFT. Fixed values of the query.
SCALE, SHIFT = 64, 1_000_000
#: Directions whose variance is below this share of the largest are rounding errors of doubles, not components.
LEAST_SHARE = 1e-9


def fixed_point(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): floor(scale * c) + shift of every entry c, as longs, for vectors whose entries are all finite.

    Vectors that are null, empty or of another length than the most frequent one (of equally frequent ones, the longest)
    are left out; entries that a double or a long can't hold exactly raise.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec"), zero=True))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    too_large = F.raise_error(F.lit(f"an entry times {scale} exceeds 2^52")).cast("long")
    entry = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale) + shift).otherwise(too_large)
    return rows.join(F.broadcast(common.select("d")), F.size("vec") == F.col("d"), "left_semi").select("id", F.transform("vec", entry).alias("x"))


def _row_matrix(df: DataFrame, array: Column, n: int, d: int) -> RowMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(array).alias("v")), "v")
    return RowMatrix(vectors, n, d)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Coordinates of all vectors on the largest components, each with variance 1.

    Returns id, component (from 1, by falling variance), n, deviation (decimal: sum over dimensions of (n * x - S)^2,
    exact), whitened, explained (share of the total variance) and identity_error (largest entry of the whitened
    coordinates' covariance minus the identity). Covariances are over all vectors, divisor n.

    :func:`fixed_point` says which vectors take part; null ids and repeated rows do. There are as many components as
    dimensions at most, and none for directions without variance (see ``LEAST_SHARE``): a single vector, equal ones or an
    empty table give no rows. Where components have equal variance, any rotation among them may come out.
    """
    spark = vectors.sparkSession
    ids = f"id {vectors.schema[id_col].dataType.simpleString()}"
    x = materialize(fixed_point(vectors, id_col, vec_col, scale, shift), "whiten-x")
    sums = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")).collect()  # a row per dimension
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    none = spark.createDataFrame([], f"{ids}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").toDF(*names)
    if not sums:
        return none
    n, d = sums[0].n, len(sums)
    total = F.array(*[F.lit(r.s) for r in sorted(sums, key=lambda r: r.i)])
    exact = F.transform("x", lambda v, i: v.cast("decimal(19,0)") * F.lit(Decimal(n)) - F.get(total, i))
    deviation = F.aggregate("off", F.lit(Decimal(0)).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    centred = x.select("id", exact.alias("off")).select("id", deviation.alias("deviation"), F.transform("off", lambda v: v.cast("double") / F.lit(float(n))).alias("c"))
    centred = materialize(centred, "whiten-centred")
    remove_scratch(x)

    trace = Fraction(int(centred.agg(F.sum(F.col("deviation"))).first()[0]), n**3)
    if not trace:
        return none
    svd = _row_matrix(centred, F.col("c"), n, d).computeSVD(min(components, d), False, LEAST_SHARE**0.5)
    variance = svd.s.toArray() ** 2 / n
    onto = svd.V.toArray() / np.sqrt(variance)
    explained = [float(Fraction(float(e)) / trace) for e in variance]

    def run(batches):
        for batch in filter(len, batches):
            w = matrix(batch.column(2)) @ onto
            coordinates = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coordinates], names=["id", "deviation", "w"])

    done = materialize(centred.select("id", "deviation", "c").mapInArrow(run, f"{ids}, deviation decimal(38,0), w array<double>"), "whitened")
    remove_scratch(centred)

    mean = done.select(Summarizer.mean(array_to_vector("w")).alias("m")).first().m.toArray()
    means = F.array(*map(F.lit, mean.tolist()))
    gram = _row_matrix(done, F.transform("w", lambda v, i: v - F.get(means, i)), n, len(variance)).computeGramianMatrix().toArray()
    error = float(np.abs(gram / n - np.eye(len(variance))).max())
    rows = done.select("id", "deviation", F.posexplode("w").alias("__i", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("__i") + 1)
    return rows.select(
        F.col("id"), (F.col("__i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    ).toDF(*names)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`whiten`; deviations as longs, which raises where a long can't hold one."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))

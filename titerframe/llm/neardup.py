"""MinHash near-duplicate detection with odd sketches.

1. A pass over the texts gives every document its shingle count, a 128-bit hash of its shingle set, MinHash band keys
   and an odd sketch: the MinHash samples folded into a bitmap by parity, so that the population count of two sketches'
   XOR estimates how many samples differ.
2. Equal sets are one class; only a class's smallest document goes on, so copies cost nothing further.
3. Classes that share a band key are compared by sketch. What passes, with a margin for the estimate's error, forms
   families (connected components); a very common key makes a family outright.
4. Full sets meet in their family, in blocks of bounded size. Sketches choose the pairs that are verified, exact
   intersections decide, and a block returns a spanning forest of its links, not the links. A family of several blocks
   is first linked inside its blocks, each of which also holds the family's few leaders: what links with a leader is
   one component already. Then only blocks of different components meet, so near copies of one page are not compared
   all with all.
5. Components of the forests are the components of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, join_counted, materialize, parallelism, scratch, slices, spread, table
from .graphs import connected_components, grouped
from .shingles import mix, shingle_sets

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bands of 5 samples: a pair at 0.85 shares none of them with probability (1 - 0.85^5)^25 = 4e-7.
BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Standard errors of the sketch's estimate below the threshold at which a pair still goes on.
MARGIN = 4.5
#: Classes of a band key that are compared by sketch; a more common key makes one family without that filter.
KEY_LIMIT = 512
#: Documents and shingles of a block of a family, and leaders of a family of several blocks.
BLOCK_DOCS, BLOCK_SHINGLES, LEADERS = 192, 400_000, 4

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLACE = _rng.integers(1, 2**64, SAMPLES, dtype=np.uint64)
_BAND = _rng.integers(1, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set under different orders of its hashes."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048, None] ^ _XOR
        x *= _MUL
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    wide = samples.astype(np.uint64).reshape(BANDS, ROWS)
    return mix((wide * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples (each with its number), as bytes."""
    places = mix(samples.astype(np.uint64) + _PLACE) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8))


def least_similarity(percent: int = PERCENT) -> float:
    j = percent / 100
    return max(0.0, j - MARGIN * (j * (1 - j) / SAMPLES) ** 0.5)


def largest_xor(similarity: float) -> int:
    """Most differing sketch bits at which the estimate is still ``similarity``; the bitmap's own error counts too."""
    differ = 2 * SAMPLES * (1 - similarity)
    share = (1 - (1 - 2 / SKETCH_BITS) ** differ) / 2
    return int(np.ceil(SKETCH_BITS * share + 2 * (SKETCH_BITS * share * (1 - share)) ** 0.5))


def row_key(id_col: str, text_col: str) -> Column:
    """Hash of a row's id and text: ids may be null or repeated."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, text_col)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """id, row (its key), n_shingles, set_a, set_b (hash of the set; null if empty), bands, sketch."""

    def run(batches):
        import xxhash

        for batch in slices(batches, 1024):
            n, ab, keys, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                samples = min_hashes(s)
                ab.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                keys.append(band_keys(samples))
                sketches.append(odd_sketch(samples).tobytes())
            if not n:
                continue
            ab, none = np.stack(ab), np.array(n) == 0
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys).view(np.int64)))
            arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ab[:, 0], mask=none), pa.array(ab[:, 1], mask=none), bands, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, row_key(id_col, text_col)).mapInArrow(run, f"id {kind}, row long, n_shingles long, set_a long, set_b long, bands array<bigint>, sketch binary")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a boolean adjacency matrix: (node, root) for every node but the roots."""
    m = len(linked)
    root = np.full(m, -1)
    out = []
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & (root < 0))
            root[new] = i
            out += [(int(x), i) for x in new]
            front = new
    return out


def close_sketches(sketches: list[bytes], worst: int) -> np.ndarray:
    """Which pairs of sketches differ in ``worst`` bits at most."""
    bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    close = np.zeros((len(bits), len(bits)), bool)
    for i in range(0, len(bits), 64):
        close[i : i + 64] = np.bitwise_count(bits[i : i + 64, None] ^ bits[None]).sum(2, dtype=np.int64) <= worst
    return close


def _edges(forests):
    """Arrow batches (a, b) of the forests of groups: (nodes, adjacency matrix) each."""
    a, b = [], []
    for nodes, linked in forests:
        for x, r in _forest(linked):
            a.append(nodes[x])
            b.append(nodes[r])
        if len(a) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _families_by_sketch(batches, worst: int):
    """(key, node, sketch) sorted by key -> edges of the candidate graph's spanning forests."""
    return _edges((t.column(1).to_numpy(), close_sketches(t.column(2).to_pylist(), worst)) for _, t in grouped(batches))


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union. Shingles of one set only are not compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    shared = counts > 1
    column[shared] = np.arange(shared.sum())
    rows, columns = np.repeat(np.arange(len(sets)), sizes), column[where]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    both = np.zeros((len(sets), len(sets)))
    step = max(64, (1 << 21) // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(columns, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[rows[a:b], columns[a:b] - lo] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None] - both
    return (100 * both >= percent * union) & (sizes > 0)[:, None] & (sizes > 0)[None]


def _verified(batches, percent: int, worst: int):
    """(family, i, j, node, sketch, set) sorted by the first three -> forests of exact links of the pairs close by sketch."""

    def forests():
        for _, t in grouped(batches, 3):
            close = close_sketches(t.column(4).to_pylist(), worst)
            np.fill_diagonal(close, False)
            some = np.flatnonzero(close.any(0))
            if len(some):
                sets = t.column(5).take(pa.array(some)).to_pylist()
                yield t.column(3).to_numpy()[some], exact_links([np.frombuffer(x, np.uint64) for x in sets], percent)

    return _edges(forests())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Near-duplicate components: id, n_shingles, component_id, kept; one row for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into ``[^\\x20\\x09-\\x0D]+`` words; a document is its set of distinct
    ``width``-word shingles (fewer words: the whole sequence). Null, empty and blank texts have no shingles and link
    with nothing. Rows are linked by set alone, so repeated rows are in one component. ``kept``: the id is the
    component's smallest. A null id is never kept unless its component has no other; rows with empty sets are
    components of their own. Other columns are not read. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        sig, names = _components(docs, id_col, text_col, percent, width)
        names = materialize(names.select("set_a", "set_b", "copies", F.col("best.id").alias("component_id")), "named")
        some = join_counted(sig.where("n_shingles > 0").select("id", "n_shingles", "set_a", "set_b"), names, ["set_a", "set_b"])
        out = some.select("id", "n_shingles", "component_id").union(sig.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
        out = materialize(out.withColumnRenamed("id", id_col), "near-duplicates", keep=True)
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and every class of equal sets (set_a, set_b, copies) with the first row of its component.

    ``best`` has none (is the id null), id and row: the smallest of them is the first row, so null ids come last.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    worst = largest_xor(least_similarity(percent))
    sig = materialize(signatures(spread(docs.select(id_col, text_col)), id_col, text_col, width), "signatures")

    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    classes = sig.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.count("*").alias("copies"), best, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a class is named by a number that is written with it: both halves of its hash tell classes apart
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    band_rows = classes.select("node", F.explode("bands").alias("key"))
    keys = band_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    candidates = materialize(band_rows.join(keys, "key"), "candidates")
    common = candidates.where(F.col("n") > KEY_LIMIT).select(F.col("node").alias("a"), F.col("least").alias("b"))
    compared = candidates.where(F.col("n") <= KEY_LIMIT).select("key", "node").join(classes.select("node", "sketch"), "node").select("key", "node", "sketch")
    close = compared.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda b: _families_by_sketch(b, worst), "a long, b long")
    families = connected_components(close.union(common))

    members = families.join(classes.select("node", F.col("best.row").alias("row"), "set_a", "set_b", "n_shingles", "sketch"), "node")
    leaders = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(LEADERS)])
    sizes = members.groupBy("component").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"), F.array_distinct(leaders).alias("leaders"))
    sizes = materialize(sizes, "families")
    members = members.join(sizes.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    members = materialize(members, "members")

    # texts move once, by the same plan at every size; should another row share a row's key, the set's hash decides
    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(members.hint("merge"), "row").drop("row")
    texts = materialize(texts, "member-texts")

    def sets(batches):
        import xxhash

        last = None  # equal rows follow each other; one of them will do
        for batch in slices(batches):
            t = batch.to_pydict()
            rows = []
            for i, s in enumerate(shingle_sets(t["text"], width)):
                if t["node"][i] != last and np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() == [t["set_a"][i], t["set_b"][i]]:
                    last = t["node"][i]
                    rows.append((t["component"][i], t["node"][i], t["at"][i], t["sketch"][i], s.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["component", "node", "at", "sketch", "set"])

    def links(placed: DataFrame) -> DataFrame:
        """Forests of the links between the texts that are ``at`` one place (i, j) of their family."""
        full = placed.select("component", "node", "at", "sketch", "set_a", "set_b", "text").mapInArrow(sets, "component long, node long, at array<struct<i:bigint,j:bigint>>, sketch binary, set binary")
        met = full.select("component", F.explode("at").alias("p"), "node", "sketch", "set").select("component", "p.i", "p.j", "node", "sketch", "set")
        met = met.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
        return met.mapInArrow(lambda b: _verified(b, percent, worst), "a long, b long")

    one = lambda b: F.struct(b.alias("i"), b.alias("j"))
    own = F.array(one(F.col("block")))
    led = sizes.where("blocks > 1").select(F.explode("leaders").alias("node"), F.lit(True).alias("leads"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), one)
    placed = texts.join(led, "node", "left").withColumn("at", F.when(F.col("leads"), every).otherwise(own))
    linked = connected_components(links(placed))

    more = _unlinked(texts.where("blocks > 1").select("component", "node", "n_shingles"), linked)
    if more is not None:
        across = links(texts.where("blocks > 1").join(more, "node"))
        linked = connected_components(across.union(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    names = classes.select("node", "set_a", "set_b", "copies", "best").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = names.groupBy("component").agg(F.min("best").alias("best"))
    return sig, names.drop("best").join(roots, "component").select("set_a", "set_b", "copies", "best")


def _blocks(docs: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _unlinked(members: DataFrame, linked: DataFrame) -> DataFrame | None:
    """node, at: where the members of large families meet those that they have no link with yet; None if nothing is left.

    Components of a block's size or more have blocks of their own, and smaller ones share blocks. Blocks of one
    component do not meet.
    """
    subs = linked.select("node", F.col("component").alias("sub"))
    members = materialize(members.distinct().join(subs, "node", "left").withColumn("sub", F.coalesce("sub", "node")), "subs")
    sub = members.groupBy("component", "sub").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    homes = sub.groupBy("component", F.when(F.col("docs") >= BLOCK_DOCS, F.col("sub")).alias("home")).agg(_blocks(F.sum("docs"), F.sum("shingles")).alias("n"), F.count("*").alias("subs"))
    alone = homes.groupBy("component").agg(F.sum("subs").alias("all")).where(F.col("all") > 1)
    homes = homes.join(alone, "component").withColumn("last", F.sum("n").over(Window.partitionBy("component").orderBy("home")))
    homes = materialize(homes.select("component", "home", "n", (F.col("last") - F.col("n")).alias("first")), "homes")
    if not homes.limit(1).count():
        return None
    # a row per family's block: with a block that it meets
    block = homes.select("component", "home", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    meets = F.collect_list(F.struct(F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"))).alias("at")
    other = homes.select("component", F.col("home").alias("their"), F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1).alias("hi"))
    pairs = block.join(other, "component").where(F.col("home").isNull() | ~F.col("home").eqNullSafe(F.col("their")))
    pairs = materialize(pairs.withColumn("k", F.explode(F.sequence("lo", "hi"))).groupBy("component", "i").agg(meets), "block-pairs")
    placed = members.join(sub.select("component", "sub", "docs"), ["component", "sub"])
    placed = placed.withColumn("home", F.when(F.col("docs") >= BLOCK_DOCS, F.col("sub"))).select("component", "node", "home")
    mine = homes.select(F.col("component").alias("c"), F.col("home").alias("h"), "n", "first")
    placed = placed.join(mine, (F.col("component") == F.col("c")) & F.col("home").eqNullSafe(F.col("h")))
    placed = placed.select("component", "node", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("n"))).alias("i"))
    return placed.join(pairs, ["component", "i"]).select("node", "at")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: the first row of every component, once. Columns stay.

    The first row has the smallest id, null last; the hash of id and text decides between rows of one id. Ids decide
    nothing else: rows that link with nothing, and rows without shingles (null, empty or blank texts), all stay,
    repeated ones too. An empty table gives no rows; other columns may have any name.
    """
    _, names = _components(docs, id_col, text_col, percent, width)
    kept = names.select(F.col("best.row").alias("__row")).distinct()
    worded = F.coalesce(F.col(text_col).rlike(f"[^{SPACE}]"), F.lit(False))
    firsts = docs.where(worded).withColumn("__row", row_key(id_col, text_col)).join(kept, "__row").dropDuplicates(["__row"])
    return firsts.select(*docs.columns).union(docs.where(~worded))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

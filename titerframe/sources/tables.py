"""Delimited metadata, layouts, training logs, result files and documents, as DataFrames with checked schemas."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROLES = ("NC", "PC", "SAMPLE")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tif", ".tiff")
LAYOUT_SCHEMA = "well string, combo_id string, race string, loci map<string,array<string>>"


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file_name, role, sample_name of a delimited file; the delimiter is found from its head, roles are checked."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
    return check_metadata(spark.read.csv(path, sep=sniff_delimiter(head), header=True))


def check_metadata(df: DataFrame) -> DataFrame:
    """Required columns, upper-case roles of the known three, the file's stem as default sample; bad rows fail when read."""
    names = {c.strip().lower(): c for c in df.columns}
    missing = {"file_name", "role"} - set(names)
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    role = F.upper(F.trim(names["role"]))
    role = F.when(role.isin(*ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))
    sample = T.clean_cell(F.col(names["sample_name"])) if "sample_name" in names else F.lit(None).cast("string")
    file = F.trim(names["file_name"])
    return df.select(file.alias("file_name"), role.alias("role"), F.coalesce(sample, T.stem(file)).alias("sample_name"))


def with_metadata(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Events with their file's role and sample; files without metadata are left out. A row per file: a dimension."""
    return events.join(metadata.withColumnRenamed("file_name", "file"), "file")


def duplicates(df: DataFrame, name: Column) -> DataFrame:
    """Names that occur more than once, whatever their case."""
    return df.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def read_request(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a request document: sample, role, file, order of the file."""
    doc = spark.read.json(path, multiLine=True, schema="samples array<struct<id:string,name:string,role:string,file_paths:array<string>>>")
    rows = doc.select(F.explode("samples").alias("s"))
    return rows.select(F.col("s.id").alias("sample_id"), F.col("s.name").alias("sample_name"), F.upper("s.role").alias("role"), F.posexplode("s.file_paths").alias("ord", "file"))


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per epoch and split of JSON-lines logs; mode, target and seed come from the file name, broken lines go."""
    raw = spark.read.json(path, mode="DROPMALFORMED", schema="epoch int, lr double, time_sec double, train map<string,double>, val map<string,double>").withColumn("file", T.base_name(F.input_file_name()))
    raw = raw.where("epoch IS NOT NULL")
    split = F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("train").alias("metrics")), F.struct(F.lit("val").alias("split"), F.col("val").alias("metrics")))).alias("s")
    rows = raw.select("file", "epoch", "lr", "time_sec", split).where("s.metrics IS NOT NULL")
    seed = F.nullif(F.regexp_extract("file", r"seed(\d+)", 1), F.lit("")).cast("int")
    target = F.nullif(F.regexp_extract("file", r"_(\d+)_seed", 1), F.lit("")).cast("int")
    return rows.select("file", F.regexp_extract("file", r"^([A-Za-z]+)", 1).alias("mode"), target.alias("target"), seed.alias("seed"), "epoch", "lr", "time_sec", "s.split", "s.metrics")


def read_score_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Wide score sheets (semicolons, a column per well) as rows: folder, annotator, well, score."""
    df = spark.read.csv(path, sep=";", header=True)
    wells = [c for c in df.columns if re.fullmatch(r"[A-F](10|[1-9])", c)]
    return df.select(F.col("Folder").alias("folder"), F.col("Annotator").alias("annotator"), *wells).unpivot(["folder", "annotator"], wells, "well", "score").select("folder", "annotator", "well", F.col("score").try_cast("double").alias("score")).where("score IS NOT NULL")


def first_present(df: DataFrame, candidates: list[str], kind: str = "double") -> Column:
    """The first of the candidate columns that a table has, coerced; values that don't parse are null."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return F.col(f"`{have[c.lower()]}`").try_cast(kind)
    raise ValueError(f"none of {candidates} in {df.columns}")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """ROI coordinates of differently labelled tables: folder, file, roi (numbered in order), y, x."""
    df = spark.read.csv(path, header=True)
    rows = df.select(first_present(df, ["Folder", "folder"], "string").alias("folder"), first_present(df, ["file_name", "image_name", "Label"], "string").alias("file"), first_present(df, ["Y", "y", "cy"]).alias("y"), first_present(df, ["X", "x", "cx"]).alias("x")).dropna()
    return rows.withColumn("roi", F.row_number().over(Window.partitionBy("folder", "file").orderBy("y", "x")) - 1)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """Non-empty cells (sheet, row, column, text) of a workbook; rows and columns count from 1."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for c in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}c"):
                v, kind = c.find("m:v", _NS), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else "") or ""
                text = shared[int(text)] if kind == "s" and text else text
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                if text.strip():
                    out.append((name.rsplit("/", 1)[-1].removesuffix(".xml"), int(row), col, text.strip()))
    return out


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks as cells: file, sha256, sheet, row, col, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, sha, content in zip(b["path"], b["sha256"], b["content"], strict=True):
                cells = xlsx_cells(content)
                yield pd.DataFrame({"file": p.rsplit("/", 1)[-1], "sha256": sha, "sheet": [c[0] for c in cells], "row": [c[1] for c in cells], "col": [c[2] for c in cells], "value": [c[3] for c in cells]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(run, "file string, sha256 string, sheet string, row int, col int, value string")


def layout_fields(grid: DataFrame, labels: dict[str, str], reach: int = 12) -> DataFrame:
    """Values right of labelled cells: for every file and name, the nearest cell within ``reach`` of one that matches."""
    structs = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(p).alias("pattern")) for n, p in labels.items()])
    hits = grid.select("file", "sheet", "row", F.col("col").alias("at"), "value", F.explode(structs).alias("f")).where(F.expr("value RLIKE f.pattern")).select("file", "sheet", "row", "at", "f.field")
    right = hits.join(grid.select("file", "sheet", "row", "col", F.col("value").alias("found")), ["file", "sheet", "row"]).where((F.col("col") > F.col("at")) & (F.col("col") <= F.col("at") + reach))
    return right.groupBy("file", "field").agg(F.min_by("found", F.struct("row", "col")).alias("value"))


def header_rows(grid: DataFrame) -> DataFrame:
    """The header row of each sheet: the first with an id and a race column, else the first dense one below a banner."""
    v = F.lower("value")
    rows = grid.groupBy("file", "sheet", "row").agg(F.bool_or(v.rlike(r"^(well|id|well id|pos\.?)$")).alias("has_id"), F.bool_or(v.rlike("^race")).alias("has_race"), F.bool_or(v.rlike("well.*reaction|reaction.*well")).alias("banner"), F.count("*").alias("dense"))
    banner = rows.where("banner").groupBy("file", "sheet").agg(F.min("row").alias("b"))
    rows = rows.join(banner, ["file", "sheet"], "left")
    exact, below = F.col("has_id") & F.col("has_race"), (F.col("row") > F.col("b")) & (F.col("row") <= F.col("b") + 9) & (F.col("dense") >= 5)
    return rows.groupBy("file", "sheet").agg(F.coalesce(F.min(F.when(exact, F.col("row"))), F.min(F.when(below, F.col("row")))).alias("header")).where("header IS NOT NULL")


def parse_layout(grid: DataFrame) -> DataFrame:
    """HLA layout of workbooks: file, well, race, combo_id, loci (map of alleles in column order).

    Rows end at the first without an id; blank and "-" alleles are none; repeated locus columns append.
    """
    head = header_rows(grid)
    h = grid.join(head.withColumnRenamed("header", "row"), ["file", "sheet", "row"])
    v = F.lower("value")
    kind = F.when(v.rlike(r"^(well|id|well id|pos\.?)$"), "id").when(v.rlike("^race"), "race").when(v.rlike("^combo"), "combo").when(v.rlike("^(ctrl|control|test)"), "skip").otherwise("locus")
    columns = h.select("file", "sheet", "col", kind.alias("kind"), T.locus(F.col("value")).alias("locus"))
    cells = grid.join(head, ["file", "sheet"]).where("row > header").join(columns, ["file", "sheet", "col"])
    ids = cells.where("kind = 'id'").select("file", "sheet", "row", "header", T.well_id(F.col("value")).alias("well")).where("well IS NOT NULL")
    run = Window.partitionBy("file", "sheet").orderBy("row")
    ids = ids.withColumns({"n": F.row_number().over(run), "first": F.min("row").over(Window.partitionBy("file", "sheet"))}).where("row - first = n - 1")
    own = cells.groupBy("file", "sheet", "row").agg(F.max(F.when(F.col("kind") == "race", F.col("value"))).alias("race"), F.max(F.when(F.col("kind") == "combo", F.col("value"))).alias("combo_id"))
    alleles = cells.where("kind = 'locus' AND value <> '-' AND locus IS NOT NULL").groupBy("file", "sheet", "row", "locus").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]).alias("alleles"))
    maps = alleles.groupBy("file", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("locus", "alleles"))).alias("loci"))
    return ids.join(own, ["file", "sheet", "row"], "left").join(maps, ["file", "sheet", "row"], "left").select("file", "well", "race", "combo_id", "loci")


def plate_size(layout: DataFrame) -> DataFrame:
    letter = F.ascii(F.substring("well", 1, 1)) - 64
    return layout.agg(F.max(letter).alias("rows"), F.max(F.regexp_extract("well", r"(\d+)$", 1).cast("int")).alias("columns"))


def read_layout_json(spark: SparkSession, path: str) -> DataFrame:
    """Layouts from JSON; loci may stand under ``loci`` or ``loci.data``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "wells map<string,string>").alias("d")).select(F.explode("d.wells").alias("key", "body"))
    plain = F.from_json("body", "well_id string, combo_id string, race string, loci map<string,array<string>>")
    nested = F.from_json(F.get_json_object("body", "$.loci.data"), "map<string,array<string>>")
    return raw.select(F.coalesce(plain["well_id"], F.col("key")).alias("well"), plain["combo_id"].alias("combo_id"), plain["race"].alias("race"), F.coalesce(nested, plain["loci"]).alias("loci"))


def layout_rows(layout: DataFrame) -> DataFrame:
    """well, locus, allele, each once."""
    return layout.select("well", F.explode("loci").alias("locus", "alleles")).select("well", "locus", F.explode("alleles").alias("allele")).distinct()


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their natural order within a folder, for joins by acquisition order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    files = files.where(F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).isin(*IMAGE_EXTENSIONS))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.withColumns({"folder": folder, "name": T.base_name(F.col("path"))}).withColumn("ord", F.row_number().over(Window.partitionBy("folder").orderBy(T.natural_key(F.col("name")))))


def write_payload(results: DataFrame, keys: list[str], path: str) -> None:
    """Results as JSON documents, one line per key, with the rows nested; NaN and infinity become null."""
    clean = {f.name: F.nanvl(f.name, F.lit(None)) for f in results.schema if f.dataType.simpleString() in ("double", "float")}
    rest = [c for c in results.columns if c not in keys]
    results.withColumns(clean).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows")).write.mode("overwrite").json(path)


def write_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def read_csv_set(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Validation tables of one header from one file or several; columns that a file lacks are null."""
    tables = [spark.read.csv(p, header=True, inferSchema=False) for p in paths]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_gate_truth(spark: SparkSession, path: str, roles: DataFrame) -> DataFrame:
    """Manual gate fractions (a column per gate path) as rows with the file's role: file, role, gate, value; a file needs one role."""
    df = spark.read.csv(path, header=True)
    gates = [c for c in df.columns if c.startswith("root/")]
    one = roles.groupBy("file").agg(F.countDistinct("role").alias("n"), F.first("role").alias("role"))
    one = one.withColumn("role", F.when(F.col("n") == 1, F.col("role")).otherwise(F.raise_error(F.concat(F.lit("several roles of "), F.col("file")))))
    return df.select("file", *gates).unpivot(["file"], gates, "gate", "value").join(one.select("file", "role"), "file").select("file", "role", "gate", F.col("value").try_cast("double").alias("value"))


CIRCLE_COLUMNS = ("image", "annotator", "roi_x_px", "roi_y_px", "center_x_px", "center_y_px", "diameter_px")


def read_circles(spark: SparkSession, path: str) -> DataFrame:
    """Annotated circles: all columns are needed, and an (image, annotator) in two files fails at run time."""
    df = spark.read.csv(path, header=True)
    if missing := set(CIRCLE_COLUMNS) - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    df = df.select(*CIRCLE_COLUMNS, F.input_file_name().alias("__file"))
    files = F.size(F.collect_set("__file").over(Window.partitionBy("image", "annotator")))
    bad = F.raise_error(F.concat_ws(" ", F.lit("annotated in several files:"), "image", "annotator")).cast("boolean")
    return df.withColumn("__n", files).where(F.when(F.col("__n") > 1, bad).otherwise(F.lit(True))).drop("__file", "__n")


def read_tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tiles per image (image, n_tiles); a tile name that occurs twice fails at run time."""
    df = spark.read.csv(path, header=True)
    names = df.groupBy("source_key", "tile").agg(F.count("*").alias("n"))
    bad = F.raise_error(F.concat(F.lit("tile twice: "), F.col("tile"))).cast("boolean")
    return names.where(F.when(F.col("n") > 1, bad).otherwise(F.lit(True))).groupBy(F.col("source_key").alias("image")).agg(F.count("*").alias("n_tiles"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file (jobs, requests, results), with the file's name."""
    return spark.read.json(path, multiLine=True, schema=schema).withColumn("file", T.base_name(F.input_file_name()))


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as JSON objects: keys, body. Null fields stay, as null."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))


def write_plot_cache(points: DataFrame, metrics: DataFrame, key: str, path: str) -> None:
    """A Parquet row per file with its sampled points and metrics, for pages that are drawn again."""
    points.join(metrics, key).write.mode("overwrite").parquet(path)

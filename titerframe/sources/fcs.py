"""Flow cytometry standard files as Spark data sources.

``spark.read.format("fcs")`` gives events in long rows (file, event_idx, channel values as an array);
``format("fcs-ranges")`` (see :func:`read_ranges`) gives chosen channels as columns and reads a file by ranges of bytes, a
large one in several tasks; ``format("fcs-text")`` is a row per file with its keywords and reads only the header and TEXT
segment. A task takes many small files. All yield Arrow batches. The path is a folder or a file in any file system that
Arrow opens by its scheme (local, hdfs, s3, gs); :func:`read_events` goes by Spark's ``binaryFile`` instead.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT_SCHEMA = "file string, keywords map<string,string>, channels array<struct<number:int,pnn:string,pns:string,png:double,pnr:double,decades:double,log0:double>>, n_events long"
EVENT_SCHEMA = "file string, event_idx long, channels array<string>, values array<float>"
_TEXT_ARROW = pa.schema([
    ("file", pa.string()), ("keywords", pa.map_(pa.string(), pa.string())),
    ("channels", pa.list_(pa.struct([("number", pa.int32()), ("pnn", pa.string()), ("pns", pa.string()), ("png", pa.float64()), ("pnr", pa.float64()), ("decades", pa.float64()), ("log0", pa.float64())]))), ("n_events", pa.int64()),
])
_ROWS = 20_000
#: Bytes of files that share tasks, about, and what opening a file counts for.
_TASK_BYTES, _OPEN_BYTES = 64 << 20, 256 << 10
#: Tasks that a file's ranges may be dealt to at any size, and bytes for each of them beyond.
_PARTS, _PART_BYTES = 32, 8 << 20


def parse_text(data: bytes) -> dict[str, str]:
    """Keywords of a file; a doubled delimiter stands for itself."""
    if data[:3] != b"FCS":
        raise ValueError("not an FCS file")
    first, last = int(data[10:18]), int(data[18:26])
    text = data[first : last + 1].decode("utf-8", "replace")
    delimiter, body = text[0], text[1:].rstrip()
    mark = "\x00"
    parts = body.replace(delimiter * 2, mark).split(delimiter)
    parts = [p.replace(mark, delimiter) for p in parts]
    return {k.strip().upper(): v.strip() for k, v in zip(parts[::2], parts[1::2], strict=False) if k.strip()}


def channel_table(keywords: dict[str, str]) -> list[dict]:
    """Channels by number, with gain, range and logarithmic scale."""
    out = []
    for i in range(1, int(keywords["$PAR"]) + 1):
        decades, log0 = (float(x) for x in keywords.get(f"$P{i}E", "0,0").split(","))
        out.append({
            "number": i, "pnn": keywords[f"$P{i}N"], "pns": keywords.get(f"$P{i}S", ""), "png": float(keywords.get(f"$P{i}G", 1) or 1), "pnr": float(keywords[f"$P{i}R"]),
            "decades": decades, "log0": 1.0 if decades and not log0 else log0,
        })
    return out


def record_type(keywords: dict[str, str]) -> np.dtype:
    """NumPy type of one event: a field per channel, of its own width; widths and types that can't be read raise."""
    order = "<" if keywords.get("$BYTEORD", "1,2,3,4").startswith("1") else ">"
    kind, n = keywords.get("$DATATYPE", "F").upper(), int(keywords["$PAR"])
    if keywords.get("$MODE", "L").upper() != "L":
        raise ValueError(f"mode {keywords['$MODE']} is not list mode")
    fields = []
    for i in range(1, n + 1):
        bits = int(keywords[f"$P{i}B"])
        allowed = {"F": {32: "f4"}, "D": {64: "f8"}, "I": {8: "u1", 16: "u2", 32: "u4", 64: "u8"}}.get(kind, {})
        if bits not in allowed:
            raise ValueError(f"channel {i} of type {kind} has {bits} bits")
        fields.append((f"c{i}", order + allowed[bits]))
    return np.dtype(fields)


def data_start(header: bytes, keywords: dict[str, str]) -> int:
    """Where the events begin: as the header says, or the keywords where it says 0."""
    first, last = int(header[26:34] or 0), int(header[34:42] or 0)
    return first if last else int(keywords["$BEGINDATA"])


def as_matrix(records: np.ndarray) -> np.ndarray:
    """Records of :func:`record_type` as float32, a column per channel."""
    out = np.empty((len(records), len(records.dtype.names)), np.float32)
    for i, name in enumerate(records.dtype.names):
        out[:, i] = records[name]
    return out


def parse_events(data: bytes, keywords: dict[str, str]) -> np.ndarray:
    """Event matrix as float32; list mode, a width of its own for every channel."""
    return as_matrix(np.frombuffer(data, record_type(keywords), int(keywords["$TOT"]), data_start(data, keywords)))


def scaled(events: np.ndarray, channels: list[dict], truncate: bool = True, timestep: float = 1.0) -> np.ndarray:
    """Range, rows that are not finite, time, logarithmic scale and gain, in this order."""
    return scaled_rows(events, channels, truncate, timestep)[0]


def scaled_rows(events: np.ndarray, channels: list[dict], truncate: bool, timestep: float) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`scaled` gives, and the places of the rows that are left."""
    x = events.astype(np.float64)
    tops = np.array([c["pnr"] for c in channels])
    if truncate:
        x = np.minimum(x, tops)
    left = np.flatnonzero(np.isfinite(x).all(1))
    x = x[left]
    for i, c in enumerate(channels):
        if c["pnn"].lower() == "time":
            x[:, i] *= timestep
        elif c["decades"] > 0:
            x[:, i] = 10 ** (c["decades"] * x[:, i] / c["pnr"]) * c["log0"]
        elif c["png"] not in (0.0, 1.0):
            x[:, i] /= c["png"]
    return x.astype(np.float32), left


def write_fcs(events: np.ndarray, names: list[str], keywords: dict[str, str] | None = None, ranges: float = 262144.0) -> bytes:
    """A float FCS 3.1 file, for fixtures and exports."""
    data = events.astype("<f4").tobytes()
    kw = {"$PAR": str(len(names)), "$TOT": str(len(events)), "$DATATYPE": "F", "$MODE": "L", "$BYTEORD": "1,2,3,4"}
    for i, n in enumerate(names, 1):
        kw |= {f"$P{i}N": n, f"$P{i}B": "32", f"$P{i}R": str(int(ranges)), f"$P{i}E": "0,0", f"$P{i}G": "1"}
    kw |= keywords or {}
    text = "/" + "/".join(f"{k}/{v.replace('/', '//')}" for k, v in kw.items()) + "/"
    begin = 256
    start = begin + len(text.encode())
    head = "FCS3.1    " + "".join(f"{v:>8}" for v in (begin, start - 1, start, start + len(data) - 1, 0, 0))
    return head.encode().ljust(begin) + text.encode() + data


def _listed(path: str) -> list[tuple[str, int]]:
    """The .fcs files under a folder, or a file, with their sizes, in any file system that Arrow knows by the path's scheme."""
    if re.search(r"[*?\[]", path):  # a pattern of names in one folder
        folder, _, pattern = path.rpartition("/")
        return [(p, n) for p, n in _listed(folder) if p.rpartition("/")[0].endswith(folder.rstrip("/")) and fnmatch.fnmatch(p.rpartition("/")[2], pattern)]
    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    root = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((root + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".fcs"))


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # with one slash or three
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _opening(path: str) -> tuple[pa.NativeFile, bytes, dict[str, str]]:
    """An open file, its header and its keywords; only these are read."""
    system, at = _system(path)
    f = system.open_input_file(at)
    header = f.read_at(58, 0)
    return f, header, parse_text(f.read_at(int(header[18:26]) + 1, 0))


@dataclass
class _Share(InputPartition):
    """Files of one task: each by its path, how many tasks share its ranges, and which of these tasks it is."""

    files: list[tuple[str, int, int]]


def _shares(files: list[tuple[str, int]], tasks: int, rows: int = 0) -> list[_Share]:
    """Files dealt to tasks: small ones together, by the sizes that listing gives.

    With ``rows`` the ranges of a file go to tasks of their own. How many there are is told by the size and the first header
    of the files that lie together; where that is wrong, a task takes more ranges or none.
    """
    most = min(_TASK_BYTES, sum(size + _OPEN_BYTES for _, size in files) // max(1, tasks))
    together: list[list[tuple[str, int]]] = []
    room = 0
    for path, size in files:
        if not together or room < size + _OPEN_BYTES:
            together.append([])
            room = most
        together[-1].append((path, size))
        room -= size + _OPEN_BYTES
    out: list[_Share] = []
    for block in together:
        start, width = 0, 1
        if rows:
            f, header, kw = _opening(block[0][0])
            f.close()
            start, width = data_start(header, kw), rows * max(1, record_type(kw).itemsize)
        parts = [max(1, min(-((start - size) // width), max(_PARTS, size // _PART_BYTES))) if rows else 1 for _, size in block]
        out += [_Share([(path, k, i) for (path, _), k in zip(block, parts, strict=True) if i < k]) for i in range(max(parts))]
    return out


class _Reader(DataSourceReader):
    """Lists files on the driver; tasks read headers, and events by ranges of bytes, as Arrow batches of about ``_ROWS`` rows."""

    def __init__(self, options: dict, kind: str):
        self.options, self.kind = options, kind

    def partitions(self) -> list[_Share]:
        rows = int(self.options.get("rowsPerPartition", 1_000_000)) if self.kind == "ranges" else 0
        return _shares(_listed(self.options["path"]), int(self.options.get("tasks", 1)), rows)

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for path, parts, part in partition.files:
            for batch in self._read(path, parts, part):
                held.append(batch)
                n += batch.num_rows
                if n >= _ROWS:
                    yield pa.concat_batches(held)
                    held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    def _read(self, path: str, parts: int, part: int) -> Iterator[pa.RecordBatch]:
        name = os.path.basename(path)
        f, header, kw = _opening(path)
        with f:
            channels = channel_table(kw)
            if self.kind == "text":
                row = {"file": name, "keywords": list(kw.items()), "channels": channels, "n_events": int(kw.get("$TOT", 0))}
                yield pa.RecordBatch.from_pylist([row], schema=_TEXT_ARROW)
                return
            record, start, total = record_type(kw), data_start(header, kw), int(kw["$TOT"])
            truncate, step = self.options.get("truncate", "true") == "true", float(kw.get("$TIMESTEP", 1) or 1)
            names = [c["pnn"] for c in channels]
            wanted = json.loads(self.options["channels"]) if self.kind == "ranges" else names
            at = [names.index(c) for c in wanted]
            rows = int(self.options.get("rowsPerPartition", 1_000_000)) if self.kind == "ranges" else max(1, total)
            kept = 0
            for first in range(part * rows, total, parts * rows):
                for lo in range(first, min(first + rows, total), _ROWS):
                    n = min(_ROWS, first + rows - lo, total - lo)
                    data = f.read_at(n * record.itemsize, start + lo * record.itemsize)
                    x, left = scaled_rows(as_matrix(np.frombuffer(data, record, n)), channels, truncate, step)
                    files = pa.array([name]).take(pa.array(np.zeros(len(x), np.int32)))
                    if self.kind == "ranges":
                        arrays = [files, pa.array(lo + left), *(pa.array(x[:, i].astype(np.float64)) for i in at)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["file", "position", *wanted])
                    else:  # numbered as rows that are left
                        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), v) for v in (pa.array(names * len(x), pa.string()), pa.array(x.ravel()))]
                        yield pa.RecordBatch.from_arrays([files, pa.array(np.arange(kept, kept + len(x))), *lists], names=["file", "event_idx", "channels", "values"])
                        kept += len(x)


class FcsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, "events")


class FcsTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs-text"

    def schema(self) -> str:
        return TEXT_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, "text")


class FcsRangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs-ranges"

    def schema(self) -> str:
        return "file string, position long" + "".join(f", `{c}` double" for c in json.loads(self.options["channels"]))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, "ranges")


def register(spark: SparkSession) -> None:
    for source in (FcsSource, FcsTextSource, FcsRangesSource):
        spark.dataSource.register(source)


def read_ranges(spark: SparkSession, path: str, channels: list[str], rows: int = 1_000_000, truncate: bool = True) -> DataFrame:
    """Wide events (file, position, a column per channel), read by ranges of ``rows`` events.

    The ranges of a file go to different tasks (up to 32, and one for every 8 MB); small files share their tasks.
    ``position`` is the event's place in its file; events that are not finite are left out, so there are gaps.
    """
    register(spark)
    tasks = spark.sparkContext.defaultParallelism
    return spark.read.format("fcs-ranges").options(channels=json.dumps(channels), rowsPerPartition=rows, truncate=str(truncate).lower(), tasks=tasks).load(path)


def write_files(events: DataFrame, file_col: str, order: list[str | Column], channels: list[str], path: str, limit: float = 262144.0) -> DataFrame:
    """Write a float FCS file per value of ``file_col``, its events in ``order``, columns or sort orders; returns file and n, when it is read.

    Events that ``order`` leaves tied go by their channels, so that a file is the same at every run. Spark sorts the events; a
    task writes one file after the other and holds one at a time. A task that is repeated writes its files again. Null files are left out.
    """
    kind = events.schema[file_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _system(path)
        system.create_dir(at, recursive=True)
        file, held, done = None, [], []

        def finish() -> None:
            x = np.concatenate(held)
            with system.open_output_stream(f"{at}/{file}.fcs") as out:
                out.write(write_fcs(x, channels, ranges=limit))
            done.append((file, len(x)))

        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(0)
            x = np.stack([np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), np.float32) for i in range(len(channels))], 1)
            codes = files.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                value = files[int(a)].as_py()
                if held and value != file:
                    finish()
                    held = []
                file = value
                held.append(x[a:b])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], files.type), pa.array([n for _, n in done], pa.int64())], names=["file", "n"])
                done = []
        if held:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], files.type), pa.array([n for _, n in done], pa.int64())], names=["file", "n"])

    by = [c if isinstance(c, Column) else F.asc_nulls_last(c) for c in (*order, *channels)]
    rows = events.where(F.col(file_col).isNotNull()).repartition(file_col).sortWithinPartitions(file_col, *by)
    return rows.select(file_col, *channels).mapInArrow(run, f"file {kind}, n long")


def read_events(spark: SparkSession, path: str, channels: list[str], truncate: bool = True) -> DataFrame:
    """Wide events (file, event_idx, a column per channel) from any store that Spark reads, via ``binaryFile``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                kw = parse_text(data)
                table = channel_table(kw)
                at = [[c["pnn"] for c in table].index(n) for n in channels]
                x = scaled(parse_events(data, kw), table, truncate, float(kw.get("$TIMESTEP", 1) or 1))
                for lo in range(0, len(x), _ROWS):
                    part = x[lo : lo + _ROWS, at]
                    out = pd.DataFrame(part.astype(np.float64), columns=channels)
                    out.insert(0, "event_idx", np.arange(lo, lo + len(part)))
                    out.insert(0, "file", os.path.basename(name))
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fcs").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, event_idx long, " + ", ".join(f"`{c}` double" for c in channels))


def panel_overlap(texts: DataFrame) -> DataFrame:
    """Channels over all files of a text scan: in how many files, and whether in all."""
    n = texts.agg(F.count("*").alias("files"))
    c = texts.select("file", F.explode("channels.pnn").alias("channel")).groupBy("channel").agg(F.countDistinct("file").alias("n"))
    return c.crossJoin(F.broadcast(n)).select("channel", "n", (F.col("n") == F.col("files")).alias("everywhere"))  # n: one row

"""Removal of repeated byte strings with run-length indexes.

A string of MIN_LENGTH bytes that starts anywhere twice is to go. Every such window of bytes holds an anchor: the
smallest hash of its K-byte grams, a choice that depends on the window's bytes alone, so equal windows have equal
anchors at equal distances. The windows with one anchor make up a stretch of text.

1. A pass over the texts returns a row per anchor: gram hash, hash of the stretch, place. Grams seen once drop out.
2. A stretch that occurs twice repeats in every window. What is left to decide is which windows *different* stretches
   of one gram have in common.
3. Those stretches, each once, are sharded by gram, so all occurrences of a window meet. A shard is indexed as a
   run-length compressed Burrows-Wheeler transform: runs of equal characters in suffix order, and for run ends a sample
   of the suffix and of its match with the neighbour. Streaming over the text from sample to sample gives the matching
   statistics (inside a run the match shrinks by one per character), and windows whose match is long enough are marked.
4. A gram with more different stretches than an index holds is sharded further. Windows are told apart by how far
   ahead of the anchor they start; those of STEP neighbouring distances share all but STEP - 1 of their bytes, a core.
   Equal windows have equal cores, so a stretch goes, in pieces of STEP windows, to the shards of its cores. Equal
   pieces repeat in every window; the different ones of a core are indexed. Where even these are too many for an index,
   the step is one: the core is the window, and windows that come twice repeat.
5. Marked windows go back to their documents, where overlapping ones merge.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, parallelism, remove_scratch, slices, spread, table
from .graphs import grouped
from .shingles import mix, powers

MIN_LENGTH = 200
#: Bytes of a gram. Windows hold MIN_LENGTH - GRAM + 1 of them and take the smallest.
GRAM = 24
#: Different strings that are indexed together, and windows of a piece where a gram has more stretches than that.
SHARD_STRINGS, STEP = 1024, 24
#: Text handled at a time inside a task, and text of one index.
CHUNK, SHARD = 1 << 20, 1 << 19


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes, k a multiple of 8: of three or so 8-byte words."""
    n = len(data) - k + 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    eights = np.ascontiguousarray(words).view("<u8").ravel()
    total = np.zeros(n, np.uint64)
    for i in range(0, k, 8):
        total += eights[i : i + n]
        total *= np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        total ^= total >> np.uint64(29)
    return mix(total)


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w consecutive keys, by doubling."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _prefix(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Running sums from which the hash of any range follows, see :func:`_range_hash`."""
    up, _ = powers(len(data) + 1)
    value = mix(np.arange(seed, seed + 256, dtype=np.uint64))[data]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * up[:-1], out=out[1:])
    return out


def _range_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def parts_of(texts: list[bytes], length: int) -> tuple[list[int], list[int], list[bytes]]:
    """Texts as parts of at most about CHUNK bytes whose windows join without gap or overlap: text, first byte, bytes."""
    rows, at, parts = [], [], []
    for row, b in enumerate(texts):
        for lo in range(0, len(b) - length + 1, CHUNK):
            rows.append(row)
            at.append(lo)
            parts.append(b[lo : lo + CHUNK + length - 1])
    return rows, at, parts


def anchors(parts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """For the windows of some texts: text, gram hash, two stretch hashes, first window, number of windows, anchor's distance."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    grams = _gram_hashes(data, k)
    low = np.uint64((1 << 24) - 1)
    # leftmost of the smallest: the place is below the hash in the key
    at = (_window_minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
    # windows that reach into the next text belong to none
    text = np.full(len(at), -1, np.int32)
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        text[a : b - length + 1] = i
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(first, append=len(at))
    first, count = first[text[first] >= 0], count[text[first] >= 0]
    anchor, text = at[first], text[first]
    ahead = mix((anchor - first).astype(np.uint64))
    stretch, check = (_range_hash(_prefix(data, seed), first, first + count - 1 + length) + ahead for seed in (1, 1000))
    return text, grams[anchor], stretch, check, first - starts[text], count, anchor - first


# ------------------------------------------------------------------------------------------- the run-length index


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(symbols)
    shift = max(1, int(symbols.max()).bit_length())
    rank, have = symbols.astype(np.uint64) + np.uint64(1), 1
    bits = shift + 1
    while have * 2 * bits <= 62:  # several symbols fit a key before the first sort
        nxt = np.zeros(n, np.uint64)
        nxt[: n - have] = rank[have:]
        rank = (rank << np.uint64(have * bits)) | nxt
        have *= 2
    order = np.argsort(rank, kind="stable")
    while True:
        step = rank[order]
        new = np.zeros(n, np.uint64)
        new[order] = np.cumsum(np.concatenate([[0], step[1:] != step[:-1]])).astype(np.uint64)
        rank = new
        if have >= depth or int(rank[order[-1]]) == n - 1:
            return order
        nxt = np.zeros(n, np.uint64)
        nxt[: n - have] = rank[have:] + np.uint64(1)
        rank = (rank << np.uint64(32)) | nxt
        order = np.argsort(rank, kind="stable")
        have *= 2


def common_prefix(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most ``most``."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.full(8, -1, symbols.dtype)])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(most):
        x, y = np.minimum(a[live] + at, n), np.minimum(b[live] + at, n + 1)
        live = live[padded[x] == padded[y]]
        if not len(live):
            break
        out[live] = at + 1
    return out


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of a collection of byte strings, with sampled run ends.

    ``symbols`` are the strings' bytes with a different separator behind each, so that matches end with the string.
    Suffixes are sorted by their first ``depth`` symbols; longer matches count as ``depth``.
    """

    def __init__(self, strings: list[bytes], depth: int):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        self.symbols = np.empty(int((lengths + 1).sum()), np.int64)
        mask = np.ones(len(self.symbols), bool)
        mask[self.starts + lengths] = False
        self.symbols[mask] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
        self.symbols[~mask] = np.arange(len(strings))
        order = suffix_order(self.symbols, depth)
        bwt = self.symbols[order - 1]  # the first symbol's predecessor is the last separator
        head = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        #: The transform as runs: character and length.
        self.run_symbol, self.run_length = bwt[head], np.diff(head, append=len(bwt))
        #: Samples where a run begins (against the suffix before) and where one ends (against the suffix behind).
        tail = np.append(head[1:] - 1, len(bwt) - 1)
        self.head_suffix, self.tail_suffix = order[head], order[tail]
        between = common_prefix(self.symbols, order[tail[:-1]], order[head[1:]], depth)
        self.head_match, self.tail_match = np.concatenate([[0], between]), np.concatenate([between, [0]])

    def matching_statistics(self) -> np.ndarray:
        """For every text position the longest match with another place, up to ``depth``, from the samples alone.

        A suffix that stands inside a run has the same neighbour as the suffix that starts one symbol earlier, one
        shorter by a symbol; so between two samples, in text order, the match shrinks by one a step.
        """
        out = np.zeros(len(self.symbols), np.int64)
        for suffix, match in ((self.head_suffix, self.head_match), (self.tail_suffix, self.tail_match)):
            by_place = np.argsort(suffix)
            place, length = suffix[by_place], match[by_place]
            if not len(place):
                continue
            every = np.arange(len(out))
            sample = np.searchsorted(place, every, "right") - 1
            value = np.where(sample >= 0, length[sample] - (every - place[sample]), 0)
            np.maximum(out, value, out=out)
        return out


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Windows (starts) of every string that occur elsewhere in the collection."""
    # a capped sample may hide that the true match is longer: sampled depth leaves room for the longest string
    index = RunLengthIndex(strings, max(map(len, strings)) + 1)
    long = index.matching_statistics() >= length
    return [np.flatnonzero(long[s : s + len(x)]) for s, x in zip(index.starts, strings, strict=True)]


# ----------------------------------------------------------------------------------------------------- Spark jobs

#: A place packs first window (40 bits), number of windows and the anchor's distance (12 bits each).
_N, _AHEAD = 1 << 12, 1 << 24


def _batched(batch: pa.RecordBatch, length: int):
    """Parts of a batch (rid, text), about CHUNK / 2 bytes at a time."""
    rows, at, parts = parts_of([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], length)
    lo, size = 0, 0
    for i, p in enumerate(parts):
        size += len(p)
        if size > CHUNK // 2 or i == len(parts) - 1:
            yield np.array(rows[lo : i + 1]), np.array(at[lo : i + 1]), parts[lo : i + 1]
            lo, size = i + 1, 0


def _batch_of(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, 1024):
            rid = batch.column("rid").to_numpy()
            for rows, at, parts in _batched(batch, length):
                text, gram, stretch, check, first, count, ahead = anchors(parts, length, k)
                place = ((first + at[text]) * _AHEAD) + count * _N + ahead
                arrays = [pa.array(rid[rows[text]]), *(pa.array(x.view(np.int64)) for x in (gram, stretch, check)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "gram", "stretch", "check", "place"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, gram long, stretch long, check long, place long")


#: What is indexed: strings by shard, named by two hashes, with the number of their copies and one place.
_STRINGS = pa.schema([(c, pa.int64()) for c in ("shard", "name", "check", "copies", "rid", "first")] + [("part", pa.binary())])
_STRINGS_SQL = "shard long, name long, check long, copies long, rid long, first long, part binary"


def _wanted(batches, length: int):
    """(text, wanted) -> the text's row, what is wanted of it, its first window, number of windows, anchor's distance, bytes."""
    for batch in batches:
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                first, n, ahead = w["place"] // _AHEAD, w["place"] % _AHEAD // _N, w["place"] % _N
                yield rid, w, first, n, ahead, data[first : first + n - 1 + length]


def _stretches(batches, length: int, most: int):
    """(text, wanted: [(gram, stretch, check, copies, kinds, place)]) -> the stretches of grams of ``most`` kinds at most."""
    for batch in slices(batches, 128):
        rows = [(w["gram"], w["stretch"], w["check"], w["copies"], rid, first, part) for rid, w, first, _, _, part in _wanted([batch], length) if w["kinds"] <= most]
        if rows:
            yield _batch_of(zip(*rows, strict=True), _STRINGS)


def _pieces(batches, length: int, most: int, step: int):
    """The stretches of the other grams in pieces of ``step`` distances to the anchor; the shard is gram, distance and core."""
    import xxhash

    for batch in slices(batches, 128):
        rows = []
        for rid, w, first, n, ahead, part in _wanted([batch], length):
            if w["kinds"] <= most:
                continue
            for j in range((ahead - n + 1) // step, ahead // step + 1):
                lo, hi = max(0, ahead - (j + 1) * step + 1), min(n - 1, ahead - j * step)  # windows of the stretch
                core = part[ahead - j * step : ahead - (j + 1) * step + 1 + length]
                shard = xxhash.xxh3_64_intdigest(core, seed=(w["gram"] + j) % 2**64)
                piece = part[lo : hi + length]
                name = np.frombuffer(xxhash.xxh3_128_digest(piece, seed=ahead - lo), np.int64)
                rows.append((shard - 2**63, int(name[0]), int(name[1]), w["copies"], rid, first + lo, piece))
        if rows:
            yield _batch_of(zip(*rows, strict=True), _STRINGS)


def _windows(batches, length: int):
    """Strings -> their windows, one by one: shard, two hashes, copies, rid, first."""
    for batch in slices(batches, 1024):
        parts = batch.column("part").to_pylist()
        if not parts:
            continue
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = np.array([len(p) - length + 1 for p in parts])
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        which = np.repeat(np.arange(len(parts)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = starts[which] + within
        names = [_range_hash(_prefix(data, seed), at, at + length).view(np.int64) for seed in (1, 1000)]
        shard, copies, rid, first = (batch.column(c).to_numpy()[which] for c in ("shard", "copies", "rid", "first"))
        arrays = [pa.array(x) for x in (shard, *names, copies, rid, first + within)]
        yield pa.RecordBatch.from_arrays(arrays, names=_STRINGS.names[:-1])


def _indexed(batches, length: int):
    """Strings sorted by shard -> spans of repeated windows of those without copies."""

    def spans(rows):
        marks: list[list] = [[], [], []]
        for windows, (copies, rid, first, _) in zip(repeated_windows([r[3] for r in rows], length), rows, strict=True):
            if copies > 1 or not len(windows):
                continue  # strings with copies are marked as a whole elsewhere
            cut = np.flatnonzero(np.diff(windows) > 1)
            for a, b in zip(windows[np.append(0, cut + 1)], windows[np.append(cut, len(windows) - 1)], strict=True):
                for c, v in zip(marks, (rid, first + int(a), first + int(b) + length), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in marks], names=["rid", "start", "stop"])

    shard, size = [], 0
    for _, t in grouped(batches):
        seen = {}
        for a, b, *row in zip(*(t.column(i).to_pylist() for i in range(1, 7)), strict=True):
            seen.setdefault((a, b), row)  # a text that stands in two equal rows comes twice
        shard += seen.values()
        size += sum(len(r[3]) for r in seen.values())
        if size > SHARD:
            yield spans(shard)
            shard, size = [], 0
    if shard:
        yield spans(shard)


def _index(strings: DataFrame, length: int) -> DataFrame:
    dealt = strings.repartition(parallelism(strings.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lambda b: _indexed(b, length), "rid long, start long, stop long")


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH, gram: int = GRAM, shard_strings: int = SHARD_STRINGS, step: int = STEP) -> DataFrame:
    """Spans of repeated bytes (rid, start, stop) of ``docs`` (rid, text); they may overlap."""
    named = ["gram", "stretch", "check"]
    every = materialize(_anchor_rows(docs, length, gram), "anchors")
    twice = materialize(every.groupBy("gram").agg(F.count("*").alias("copies")).where("copies > 1"), "twice")
    shared = materialize(join_counted(every, twice, ["gram"]).drop("copies"), "shared")
    for done in (every, twice):
        remove_scratch(done)

    kinds = shared.groupBy(*named).agg(F.count("*").alias("copies"), F.min(F.struct("rid", "place")).alias("one"))
    kinds = materialize(kinds, "kinds")
    whole = join_counted(shared, kinds.where("copies > 1").select(*named, "copies"), named)
    first, count = F.floor(F.col("place") / _AHEAD), F.floor(F.col("place") % _AHEAD / _N)
    spans = [materialize(whole.select("rid", first.alias("start"), (first + count - 1 + length).alias("stop")), "whole")]
    remove_scratch(shared)

    several = materialize(kinds.groupBy("gram").agg(F.count("*").alias("copies")).where("copies > 1"), "several")
    wanted = join_counted(kinds.withColumnRenamed("copies", "n"), several, ["gram"])
    wanted = wanted.select("one.rid", F.struct(*named, F.col("n").alias("copies"), F.col("copies").alias("kinds"), "one.place").alias("w"))
    wanted = materialize(wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted")), "wanted")  # bounded by the text
    texts = materialize(docs.join(wanted.hint("merge"), "rid").select("rid", "text", "wanted"), "wanted-texts")
    spans.append(materialize(_index(texts.mapInArrow(lambda b: _stretches(b, length, shard_strings), _STRINGS_SQL), length), "indexed"))

    if _some(several.where(F.col("copies") > shard_strings)):
        parts = materialize(texts.mapInArrow(lambda b: _pieces(b, length, shard_strings, step), _STRINGS_SQL), "pieces")
        named = ["shard", "name", "check"]
        kept = F.min(F.struct("rid", "first", "part")).alias("one")
        different = materialize(parts.groupBy(*named).agg(F.count("*").alias("copies"), F.max("copies").alias("n"), kept), "piece-kinds")
        whole = join_counted(parts.select(*named, "rid", "first", (F.col("first") + F.length("part")).alias("stop")), different.where("copies > 1").select(*named, "copies"), named)
        spans.append(materialize(whole.select("rid", F.col("first").alias("start"), "stop"), "whole-pieces"))
        cores = materialize(different.groupBy("shard").agg(F.count("*").alias("copies")).where("copies > 1"), "cores")
        met = different.select(*named, F.greatest("copies", "n").alias("n"), "one.*")
        met = materialize(join_counted(met, cores, ["shard"]).select(*named, F.col("n").alias("copies"), "rid", "first", "part", F.col("copies").alias("kinds")), "cored-pieces")
        spans.append(materialize(_index(met.where(F.col("kinds") <= shard_strings).drop("kinds"), length), "indexed-pieces"))
        large = met.where(F.col("kinds") > shard_strings).drop("kinds")
        if _some(large):
            windows = materialize(large.mapInArrow(lambda b: _windows(b, length), _STRINGS_SQL.rsplit(",", 1)[0]), "windows")
            again = materialize(windows.groupBy(*named).agg(F.count("*").alias("copies")).where("copies > 1"), "again")
            marked = join_counted(windows.drop("copies"), again, named).select("rid", F.col("first").alias("start"), (F.col("first") + length).alias("stop"))
            spans.append(materialize(marked, "window-spans"))
            for done in (windows, again):
                remove_scratch(done)
        for done in (parts, different, cores, met):
            remove_scratch(done)
    for done in (kinds, several, wanted, texts):
        remove_scratch(done)
    return reduce(DataFrame.union, spans)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, gram: int = GRAM, shard_strings: int = SHARD_STRINGS, with_kept: bool = False, carry: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere in the corpus.

    Returns a row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_kept`` also kept (the
    remaining text; a character that lost some of its bytes goes whole), with ``carry`` the other columns of ``docs``
    (a clashing name is the operator's). Strings are judged on the texts as they come, within one
    text too; matches never cross texts. ``shard_strings`` bounds an index, not what is found. A null text is empty. Equal rows repeat each other. Ids may be null or
    repeated: places are by the hash of id and text. An empty table gives no rows.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    extra = [c for c in docs.columns if c not in (id_col, *own)] if carry else []
    rows = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(spread(rows), length, gram, shard_strings)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    whole = docs.select(F.xxhash64(id_col, text_col).alias("__rid"), id_col, *extra, F.col(text_col).cast("string").alias("__text"))
    joined = whole.join(spans.withColumnRenamed("rid", "__rid").hint("merge"), "__rid", "left").select(id_col, *extra, "__text", "spans")

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in own]
            texts, marks = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            bounds = marks.offsets.to_numpy()  # into all values: a slice of a batch keeps those of the batch
            start, stop = (marks.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, text in enumerate(texts.to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                a, b = start[bounds[i] : bounds[i + 1]], stop[bounds[i] : bounds[i + 1]]
                n_spans = 0
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    head = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                    a, reach = a[head], reach[np.append(head[1:] - 1, len(reach) - 1)]
                    n_spans = len(a)
                    kept = b"".join(data[x:y] for x, y in zip(np.append(0, reach).tolist(), np.append(a, len(data)).tolist(), strict=True))
                else:
                    kept = data
                for c, v in zip(out, (len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_kept else None), strict=False):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=[*batch.schema.names[:-2], *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_kept
    return joined.mapInArrow(run, schema)


def keep_unrepeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts; rows and columns stay, null texts too.

    A column n_chars follows a text that changed. Rows that repeat, or share an id or have none, each keep what is left of
    their own text (copies of 200 bytes or more lose all of them); an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*rest, F.col(text_col).isNull().alias("__null")).alias("__row"))
    kept = drop_repeats(rows, "id", "text", with_kept=True, carry=True, **options)
    new = {c: F.col("__row")[c] for c in rest} | {text_col: F.when(~F.col("__row")["__null"], F.col("kept"))}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return kept.select(*[new[c].alias(c) for c in docs.columns])


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

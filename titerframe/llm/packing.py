"""Best-fit packing of tokenized documents into sequences.

How well documents pack depends on their lengths alone, and a capacity of C tokens allows C different lengths. So Spark
tokenizes and counts lengths, the driver plans on that histogram (at most C rows at any corpus size) by bin
completion, and Spark deals the pieces out: rank of a piece among those of its length -> place in the plan.
"""

from __future__ import annotations

import array
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, spread, table

CAPACITY = 2048
END_ID = 0
#: Pieces per window group when ranks are numbered; a frequent length is dealt to as many groups as it needs.
RANK_GROUP = 200
#: Nodes of the branch-and-bound search beyond the first descent, and fillings that a node branches over. They bound the
#: search, not what is packed.
NODES, WIDTH = 200, 3

# ---------------------------------------------------------------------------------------------------- tokenizing

#: Pre-tokenization pattern of the vocabulary file. Fixed value.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of these characters only need no normalization but lower-casing (0130 lower-cases to two characters).
_PLAIN = re.compile("[!-;=-~\n¡-įı-ɏ]+").fullmatch


class _Ids(dict):
    """Little-endian ids of a chunk of text. Encodings never cross a space, so chunks between spaces are cached."""

    LIMIT = 300_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pretokens = self.tokenizer.model, regex.compile(_PRETOKEN).findall
        self.by_pretoken: dict[str, bytes] = {}
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in visible]
        self.byte_chars = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pretoken(self, w: str) -> bytes:
        if (out := self.by_pretoken.get(w)) is None:
            letters = w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_chars)
            out = array.array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(w) < 64:
                if len(self.by_pretoken) >= 2 * self.LIMIT:
                    self.by_pretoken.clear()
                self.by_pretoken[w] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN(chunk) and len(chunk) < 256:
            out = b"".join(map(self.pretoken, self.pretokens(chunk.lower())))
        else:
            out = self.whole(chunk)
        if len(chunk) < 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split(" ")))


_loaded: dict[str, _Ids] = {}


def encoder(path: str) -> _Ids:
    """The encoder of a vocabulary file, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = _Ids(path)
    return _loaded[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    end = array.array("I", [end_id]).tobytes()
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        ids_of = encoder(_vocabulary(vocabulary))
        for batch in slices(batches, 1024):
            ids, texts = batch.column(0), batch.column(1)
            out: list[list] = [[] for _ in range(6)]
            for row in range(len(texts)):
                b = ids_of.encode(texts[row].as_py() or "") + end
                for piece, at in enumerate(range(0, len(b), 4 * capacity)):
                    part = b[at : at + 4 * capacity]
                    for column, v in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=True):
                        column.append(v)
            arrays = [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------------------ planning


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the volume bound, sharpened for every size k by keeping pieces over C - k apart."""
    lengths = np.arange(capacity + 1)
    volume = counts * lengths
    best = -(-int(volume.sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        large = int(counts[capacity - k + 1 :].sum())
        half = int(counts[capacity // 2 + 1 : capacity - k + 1].sum())
        free = half * capacity - int(volume[capacity // 2 + 1 : capacity - k + 1].sum())
        small = int(volume[k : capacity // 2 + 1].sum())
        best = max(best, large + half + max(0, -(-(small - free) // capacity)))
    return best


class _Stock:
    """Remaining lengths, largest findable below a bound."""

    def __init__(self, counts: list[int]):
        self.counts = list(counts)
        self.lengths = [x for x, n in enumerate(self.counts) if n]

    def take(self, filling: tuple, times: int) -> None:
        for length, k in filling:
            self.counts[length] -= k * times
            if not self.counts[length]:
                del self.lengths[bisect_right(self.lengths, length) - 1]

    def at_most(self, bound: int) -> int:
        """Index of the largest remaining length <= bound, -1 if none."""
        return bisect_right(self.lengths, bound) - 1


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit inside the pieces of ``a``: a bin completed by ``a`` is then no worse.

    Exact where ``a`` has at most two pieces (by the sums that parts of ``b`` have, as bits). Beyond that, dealing out
    best-fit decreasing proves it or leaves it open, and what is open counts as undominated.
    """
    total = sum(b)
    if sum(a) < total or max(b, default=0) > max(a, default=0):
        return False
    if len(a) <= 2:
        sums = 1
        for y in b:
            sums |= sums << y
        x, rest = max(a, default=0), min(a) if len(a) == 2 else 0
        low = max(0, total - rest)  # the part in x takes at least what the other piece cannot
        return low <= x and bool(sums >> low & ((1 << (x - low + 1)) - 1))
    rooms = sorted(a)
    for y in sorted(b, reverse=True):
        i = bisect_left(rooms, y)
        if i == len(rooms):
            return False
        insort(rooms, rooms.pop(i) - y)
    return True


def fillings(stock: _Stock, room: int, width: int = WIDTH, steps: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the stock, fullest first.

    Lengths are tried from the largest down, and a piece that fills the room exactly ends the search at its level. Of
    what is found, fillings that one before them dominates go.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    left = [steps]

    def go(room: int, bound: int, chosen: tuple[int, ...], total: int) -> bool:
        i = stock.at_most(min(room, bound))
        while i >= 0 and used.get(stock.lengths[i], 0) >= stock.counts[stock.lengths[i]]:
            i -= 1
        if i < 0:
            found.append((total, chosen))
            return False
        tries = 0
        while i >= 0 and left[0] > 0 and tries < 12:
            x = stock.lengths[i]
            if used.get(x, 0) < stock.counts[x]:
                left[0] -= 1
                tries += 1
                if x == room:
                    found.append((total + x, (*chosen, x)))
                    return True
                # two pieces: is the exact rest in stock?
                rest = room - x
                if rest <= x and stock.counts[rest] - used.get(rest, 0) - (rest == x) > 0:
                    found.append((total + room, (*chosen, x, rest)))
                    return True
                used[x] = used.get(x, 0) + 1
                exact = go(rest, x, (*chosen, x), total + x)
                used[x] -= 1
                if exact and len(found) >= width:
                    return True
                if tries == 1 and not exact and len(found) > 4 * width:
                    break
            i -= 1
        return False

    go(room, room, (), 0)
    found.sort(key=lambda f: (-f[0], len(f[1]), tuple(-x for x in f[1])))
    kept: list[tuple[int, ...]] = []
    for f in dict.fromkeys(f for _, f in found):
        if len(kept) == width:
            break
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept or [()]


def _grouped(lengths: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    out: dict[int, int] = {}
    for x in lengths:
        out[x] = out.get(x, 0) + 1
    return tuple(out.items())


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on the histogram: (filling, times) pairs; the first incumbent."""
    stock, plan = _Stock(counts.tolist()), []
    while stock.lengths:
        room, chosen, used = capacity, [], {}
        while (i := stock.at_most(room)) >= 0:
            while i >= 0 and used.get(stock.lengths[i], 0) >= stock.counts[stock.lengths[i]]:
                i -= 1
            if i < 0:
                break
            x = stock.lengths[i]
            k = min(room // x, stock.counts[x] - used.get(x, 0))
            chosen += [x] * k
            used[x] = used.get(x, 0) + k
            room -= k * x
        filling = _grouped(tuple(chosen))
        times = min(stock.counts[x] // k for x, k in filling)
        stock.take(filling, times)
        plan.append((filling, times))
    return plan


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fillings and how often each is used, covering ``counts`` (index: length) exactly.

    Bin completion: at a node the largest remaining length is completed by each of the undominated fillings, fullest
    first, used as often as the stock allows. A branch whose waste so far already costs as many bins as the incumbent
    is cut; the search ends at the lower bound or after ``nodes`` further nodes.
    """
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    bins, least = sum(t for _, t in best), lower_bound(counts, capacity)
    spent = 0
    # depth first over (plan so far, its bins, its waste, stock); alternatives wait on the stack, best on top
    stack = [([], 0, 0, counts.tolist(), 0)]
    while stack and bins > least and spent <= nodes:
        plan, used, waste, left, skip = stack.pop()
        plan, stock = list(plan), _Stock(left)
        spent += 1
        while stock.lengths:
            if -(-(total + waste) // capacity) >= bins or used >= bins:
                break
            x = stock.lengths[-1]
            stock.counts[x] -= 1
            options = fillings(stock, capacity - x)
            stock.counts[x] += 1
            pick = min(skip, len(options) - 1)
            if pick + 1 < len(options) and len(stack) < nodes:
                stack.append((list(plan), used, waste, stock.counts.copy(), pick + 1))
            skip = 0
            filling = _grouped((x, *options[pick]))
            times = min(stock.counts[y] // k for y, k in filling)
            fill = sum(y * k for y, k in filling)
            stock.take(filling, times)
            plan.append((filling, times))
            used, waste = used + times, waste + times * (capacity - fill)
        else:
            if used < bins:
                best, bins = plan, used
    return best


# ------------------------------------------------------------------------------------------------------- dealing


def _places(plan) -> dict[str, np.ndarray]:
    """For every length, its ranks in runs: first rank, pieces per sequence, first sequence, offset in it."""
    rows, given, base = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, k in filling:
            rows.append((length, given.get(length, 0), k, base, offset))
            given[length] = given.get(length, 0) + k * times
            offset += length * k
        base += times
    rows.sort()
    return {n: np.array(c, np.int64) for n, c in zip(("length", "first", "each", "base", "offset"), zip(*rows, strict=True), strict=True)} if rows else {}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, nodes: int = NODES, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the search finds.

    A document's ids are those of the vocabulary file plus ``end_id``; only longer ones are cut. Returns a row per
    piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null and empty texts are one ``end_id``. Repeated rows are packed each; null ids stay null. Other columns are not
    read. An empty table gives no rows.
    """
    pieces = materialize(tokenize_pieces(spread(docs.select(id_col, text_col)), id_col, text_col, vocabulary, capacity, end_id, with_ids), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    places = _places(plan_packing(counts, capacity, nodes))
    names = [*pieces.columns, "sequence_id", "offset"]
    if not places:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).select(names)

    # rank among the pieces of a length: numbered inside bounded groups, plus what the groups before hold
    salts = F.lit([1 + int(n) // RANK_GROUP for n in counts]).cast("array<int>")
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.element_at(salts, (F.col("length") + 1).cast("int"))))
    groups = salted.groupBy(F.col("length").alias("__length"), F.col("__salt").alias("__group")).count()
    groups = groups.withColumn("__before", F.sum("count").over(Window.partitionBy("__length").orderBy("__group")) - F.col("count")).drop("count")
    in_group = Window.partitionBy("length", "__salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.join(groups, (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__group")))
    ranked = ranked.withColumn("__rank", F.col("__before") + F.row_number().over(in_group) - 1).select(*pieces.columns, "__rank")
    wide = 1 << 40
    code = places["length"] * wide + places["first"]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(code, length * wide + rank, "right") - 1
            within, each = rank - places["first"][at], places["each"][at]
            extra = [pa.array(places["base"][at] + within // each), pa.array(places["offset"][at] + within % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one in-memory database per Python worker.

Spark splits texts into words by the vocabulary's pattern. In a partition, every word that the worker has not met yet is
a set of rows (word, position, token), first of its bytes. A recursive query joins neighbouring rows to the merge table
and contracts each word's leftmost pair of minimum rank until none is left; ordered aggregation of its tokens' bytes decodes
it. Documents gather tokens and bytes of their words, in order. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread, table

#: Words that a worker remembers before it forgets all, and tokens of a query that decodes. They bound memory, not results.
KNOWN, TOKENS = 600_000, 400_000
#: Words of at most so many bytes are contracted a pair at a time, in groups of so many bytes; longer ones every occurrence
#: of the pair at a time, in groups of more.
SHORT, SHORT_BYTES, LONG_BYTES = 48, 1 << 19, 1 << 20

# ---------------------------------------------------------------------------------------------------------- splitting


def _ranges(points: set[int]) -> str:
    """Code points as the inside of a Java character class."""
    out, p = "", sorted(points)
    cuts = [0, *(i for i in range(1, len(p)) if p[i] != p[i - 1] + 1), len(p)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            out += f"\\x{{{p[a]:X}}}-\\x{{{p[b - 1]:X}}}"
    return out


@lru_cache(maxsize=8)
def _java_patterns(spark: SparkSession, pattern: str) -> tuple[str, str, int]:
    """``pattern`` for the JVM, the same with what the JVM's Unicode version lacks, and the first code point of that.

    The tokenizer's own engine says which code points are letters and numbers, so that scripts added to Unicode after
    the JVM's version are split as it splits them.
    """
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    plain = {r"\s": r"\p{IsWhite_Space}", r"\S": r"\P{IsWhite_Space}", r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}"}
    more, first = dict(plain), 0x110000
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        bytes_only = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs = set(bytes(bytes_only.encode_ordinary(every)).decode())
        own = set(spark.sparkContext._jvm.java.util.regex.Pattern.compile(plain[name].replace(r"\p", r"\P") + "+").matcher(every).replaceAll(""))
        if own - theirs:
            raise ValueError(f"the JVM counts code points to {name} that the tokenizer does not")
        if lacking := {ord(c) for c in theirs - own}:
            more[name] = plain[name] + _ranges(lacking)
            first = min(first, *lacking)

    def java(classes: dict[str, str]) -> str:
        inside = lambda s: re.sub(r"\\s|\\S|\\p\{[LN]\}", lambda m: classes[m[0]], s)
        return re.sub(r"\[[^\]]*\]|\\s|\\S|\\p\{[LN]\}", lambda m: inside(m[0]) if m[0][0] == "[" else f"[{classes[m[0]]}]", pattern)

    return java(plain), java(more), first


def split_words(spark: SparkSession, text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in ``text`` in order, as an array; null counts as empty."""
    plain, more, first = _java_patterns(spark, pattern)
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(plain), F.lit(0))
    if plain == more:
        return found
    return F.when(text.rlike(f"[\\x{{{first:X}}}-\\x{{10FFFF}}]"), F.regexp_extract_all(text, F.lit(more), F.lit(0))).otherwise(found)


# ---------------------------------------------------------------------------------------------------- the merge table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes are a token too: a, b, id, and whether merging all its occurrences at once is safe.

    It is unless a token that starts or ends with ``id`` has a lower rank: that one would come before the next occurrence.
    """
    merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    early = {x for a, b, r in merges for x in (a, b) if r < x}
    ids = [pa.array([m[k] for m in merges], pa.int32()) for k in range(3)]
    return pa.table([*ids, pa.array([m[2] not in early for m in merges], pa.bool_())], names=["a", "b", "id", "safe"])


_BYTES = """
  SELECT w, p.pos, b.id FROM (SELECT w, unnest(range(1, 2 * strlen(word), 2))::INT AS pos, hex(word) AS h FROM fresh) p
  JOIN bytes b ON b.hex = substr(p.h, p.pos, 2)"""

#: Short words: rows know the place and token that follow. A step contracts the leftmost pair of minimum rank of every word
#: that has a pair; a word's last step counts.
_CONTRACT_SHORT = f"""
WITH RECURSIVE t(w, pos, id, next_pos, next_id, step) AS (
  SELECT w, pos, id, lead(pos) OVER (PARTITION BY w ORDER BY pos), lead(id) OVER (PARTITION BY w ORDER BY pos), 0 FROM ({_BYTES})
  UNION ALL
  SELECT t.w, t.pos, CASE WHEN t.pos = pair.pos THEN pair.id ELSE t.id END, CASE WHEN t.pos = pair.pos THEN r.next_pos ELSE t.next_pos END,
         CASE WHEN t.pos = pair.pos THEN r.next_id WHEN t.next_pos = pair.pos THEN pair.id ELSE t.next_id END, t.step + 1
  FROM t
  JOIN (SELECT l.w, arg_min(l.pos, (m.id::BIGINT << 32) + l.pos) AS pos, arg_min(l.next_pos, (m.id::BIGINT << 32) + l.pos) AS gone, min(m.id) AS id
        FROM t l JOIN merges m ON m.a = l.id AND m.b = l.next_id GROUP BY l.w) pair ON pair.w = t.w
  JOIN t r ON r.w = pair.w AND r.pos = pair.gone
  WHERE t.pos <> pair.gone
)
SELECT w, pos, id FROM t SEMI JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) last USING (w, step)"""

#: Long words: one row per place is kept, null once its token is merged into the one before. Where it is safe, a step
#: contracts all occurrences of the pair, in a run of overlapping ones every second; else the leftmost.
_CONTRACT_LONG = f"""
WITH RECURSIVE t(w, pos, id, step) USING KEY (w, pos) AS (
  SELECT *, 0 FROM ({_BYTES})
  UNION
  SELECT w, pos, CASE WHEN hit THEN merged WHEN lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) THEN NULL ELSE id END, step + 1
  FROM (
    SELECT *, same AND CASE WHEN safe THEN row_number() OVER (PARTITION BY w, same, run ORDER BY pos) % 2 = 1 ELSE code = best END AS hit
    FROM (
      SELECT *, (best >> 32)::INT AS merged, coalesce(code >> 32 = best >> 32, false) AS same,
             i - row_number() OVER (PARTITION BY w, coalesce(code >> 32 = best >> 32, false) ORDER BY pos) AS run
      FROM (
        SELECT *, min(code) OVER (PARTITION BY w) AS best
        FROM (
          SELECT p.*, m.safe, (m.id::BIGINT << 32) + p.pos AS code
          FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS after, row_number() OVER (PARTITION BY w ORDER BY pos) AS i
                FROM t WHERE id IS NOT NULL) p
          LEFT JOIN merges m ON m.a = p.id AND m.b = p.after))
      WHERE best IS NOT NULL)))
SELECT w, pos, id FROM t WHERE id IS NOT NULL"""


class _Words:
    """A worker's database: the vocabulary, and tokens and decoded bytes of the words met so far."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        hexes = pa.array([t.hex().upper() for t in ranks])
        tokens = pa.table([pa.array(ranks.values(), pa.int32()), hexes], names=["id", "hex"])
        for name, rows in (("tokens", tokens), ("merges", merge_table(ranks))):
            self.put(name, rows)
        self.db.execute("CREATE TABLE bytes AS SELECT hex, id FROM tokens WHERE strlen(hex) = 2")
        self._forget()

    def put(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _forget(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE known (word VARCHAR, ids INT[], bytes BLOB)")
        self.size = 0

    def _learn(self) -> None:
        """Add the words of the table ``met`` that are not known: tokens and, by ordered aggregation, what they decode to."""
        self.db.execute(f"""
            CREATE OR REPLACE TABLE new AS SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY w) // CASE kind WHEN 'short' THEN {SHORT_BYTES} ELSE {LONG_BYTES} END AS part FROM (
              SELECT w, word, strlen(word) AS n, CASE WHEN t.id IS NOT NULL THEN 'token' WHEN n <= {SHORT} THEN 'short' ELSE 'long' END AS kind
              FROM met ANTI JOIN known USING (word) LEFT JOIN tokens t ON t.hex = hex(word))""")
        ways = {"token": "SELECT w, 0 AS pos, t.id FROM fresh JOIN tokens t ON t.hex = hex(word)", "short": _CONTRACT_SHORT, "long": _CONTRACT_LONG}
        for kind, part, n in self.db.execute("SELECT kind, part, count(*) FROM new GROUP BY ALL ORDER BY ALL").fetchall():
            self.db.execute(f"CREATE OR REPLACE TABLE fresh AS SELECT w, word FROM new WHERE kind = '{kind}' AND part = {part}")
            self.db.execute(f"""
                INSERT INTO known SELECT word, ids, unhex(hexes) FROM fresh JOIN (
                  SELECT w, list(r.id ORDER BY pos) AS ids, string_agg(t.hex, '' ORDER BY pos) AS hexes
                  FROM ({ways[kind]}) r JOIN tokens t ON t.id = r.id GROUP BY w) USING (w)""")
            self.size += n

    def encode(self, words: pa.ListArray) -> tuple[pa.ListArray, pa.BinaryArray]:
        """Tokens and decoded bytes of lists of words: those of the words, in their order."""
        if self.size > KNOWN:
            self._forget()
        places = words.flatten().dictionary_encode()
        self.put("met", pa.table([pa.array(range(len(places.dictionary)), pa.int32()), places.dictionary], names=["w", "word"]))
        self._learn()
        out = self.db.sql("SELECT ids, bytes FROM met JOIN known USING (word) ORDER BY w").to_arrow_table()
        ids, texts = (out.column(c).combine_chunks().cast(t).take(places.indices) for c, t in (("ids", pa.list_(pa.int32())), ("bytes", pa.binary())))
        ends = pa.array(words.offsets.to_numpy() - words.offsets[0].as_py())
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        decoded = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(starts[ends.to_numpy()].tobytes()), texts.buffers()[2] or pa.py_buffer(b"")])
        return pa.ListArray.from_arrays(ids.offsets.take(ends), ids.values), decoded

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of lists of tokens; a list that is null or holds a null or an id the vocabulary lacks gives null."""
        self.put("lists", pa.table([pa.array(range(len(ids)), pa.int32()), ids], names=["doc", "ids"]))
        out = self.db.sql("""
            SELECT CASE WHEN l.ids IS NULL OR len(l.ids) > coalesce(n, 0) THEN NULL ELSE coalesce(bytes, ''::BLOB) END AS bytes FROM lists l LEFT JOIN (
              SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes, count(*) AS n
              FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) JOIN tokens USING (id) GROUP BY doc) USING (doc)
            ORDER BY doc""").to_arrow_table()
        return out.column("bytes").combine_chunks()


_opened: dict[str, _Words] = {}


def _database(path: str) -> _Words:
    """The database of a vocabulary file, once per Python worker."""
    if path not in _opened:
        _opened[path] = _Words(path)
    return _opened[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _by_length(batch: pa.RecordBatch, column: int, most: int):
    """A batch in slices whose lists hold at most ``most`` values; a longer list is a slice of its own."""
    ends = batch.column(column).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


# ------------------------------------------------------------------------------------------------------- the operators


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tokens of every text: ``id_col``, ids (array of int), decoded (binary: the bytes that the tokens stand for).

    Every match of ``pattern`` is encoded by itself, without special tokens: whole where it is a token, else by merging
    its leftmost neighbours of lowest joint rank until none has any. ``vocabulary`` is a rank file that executors can
    read too; it must hold all single bytes. A word's tokens are found, and decoded, once per worker.

    Null and empty texts have no tokens. Rows that repeat, or share an id or have none, are encoded each; an empty table
    gives no rows; other columns are not read. Texts of any length are taken whole.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path = _vocabulary(vocabulary)
    words = spread(docs.select(id_col, text_col)).select(F.col(id_col), split_words(spark, F.col(text_col), pattern or public_tokenizers.PATTERN).alias("__words"))

    def run(batches):
        known = _database(path)
        for batch in slices(batches, 4096):
            for part in _by_length(batch, 1, 4 * TOKENS):
                ids, decoded = known.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=[id_col, "ids", "decoded"])

    return words.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and decoded (binary) of rows of token ids, by ordered aggregation of the tokens' bytes.

    No tokens give no bytes; a null array, a null token or one that the vocabulary lacks gives null. Rows that repeat
    are decoded each; an empty table gives no rows.
    """
    path = _vocabulary(vocabulary)

    def run(batches):
        known = _database(path)
        for batch in slices(batches, 1024):
            for part in _by_length(batch, 1, TOKENS):
                yield pa.RecordBatch.from_arrays([part.column(0), known.decode(part.column(1)).cast(pa.binary())], names=[id_col, "decoded"])

    rows = tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids"))
    return rows.mapInArrow(run, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens of every document, and of the bytes they decode to."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

"""URL filters: exact rule lookup through a Bloom filter cascade, in SQL expressions only.

A level is a bitmap. Level 0 encodes the listed keys; level 1 encodes the keys of the corpus that level 0 accepts
wrongly; level 2 the listed keys that level 1 would turn away; and so on until a level errs for no key. A key is listed
if the first level that turns it away has an odd number (or none does and the last level encodes listed keys). That is
exact for every key of the universe that the cascade was built over, and looking a key up reads bitmaps only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, remove_scratch, table

#: (host, path, verdict). Fixed values of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bits and hashes per listed key at level 0; about one key of the universe in 10,000 is then a false positive.
BITS_PER_KEY, HASHES = 20, 7
#: A bitmap is part of the plan that goes to every task: larger lists are refused, not broadcast blindly.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    bitmap: bytes

    def test(self, key: Column) -> Column:
        bitmap = F.lit(self.bitmap)  # one value of the plan, whatever its size
        byte = lambda p: F.conv(F.hex(F.substring(bitmap, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        tests = [F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in _positions(key, self.bits, self.hashes, self.seed)]
        return reduce(lambda a, b: a & b, tests)


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 1000 + j)), F.lit(bits)) for j in range(hashes)]


def _level(keys: DataFrame, n: int, bits_per_key: float, hashes: int, seed: int) -> Level:
    """Bitmap of the column ``key``: positions meet by word, so that no task gathers more than words."""
    bits = max(64, -(-int(n * bits_per_key) // 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits exceeds {MAX_BITS}; join such a list instead")
    p = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    set_ = p.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("v"))
    bitmap = bytearray(bits // 8)
    for w, v in set_.collect():  # at most bits / 64 rows
        bitmap[8 * w : 8 * w + 8] = v.to_bytes(8, "little", signed=True)
    return Level(bits, hashes, seed, bytes(bitmap))


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: float = BITS_PER_KEY, hashes: int = HASHES, first_seed: int = 1) -> Cascade:
        """Encode the keys of ``listed`` over ``universe`` (both have a column ``key``; nulls are not keys)."""
        inside = materialize(listed.where("key IS NOT NULL").select("key").distinct(), "cascade-in")
        n = inside.count()
        if not n:
            return cls([])
        levels = [_level(inside, n, bits_per_key, hashes, first_seed)]
        # whoever is wrong at a level is encoded by the next; both sides shrink by that level's error rate
        outside = universe.where(levels[0].test(F.col("key"))).select("key").distinct().join(inside, "key", "left_anti")
        wrong, right = materialize(outside, "cascade-out"), inside
        while n := wrong.count():
            levels.append(_level(wrong, n, 3, 2, first_seed + len(levels)))
            wrong, right = materialize(right.where(levels[-1].test(F.col("key"))), "cascade"), wrong
        for df in {id(x): x for x in (wrong, right, inside)}.values():
            remove_scratch(df)
        return cls(levels)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].test(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def rule_keys(host: Column, path: Column, rules=RULES) -> list[Column]:
    """Every key under which a rule for this url could be listed, longest first.

    Only suffixes of as many labels as a rule has, and path heads of the lengths that rules have, can be keys: their
    number is bounded by the rules, not by the url. A key that the url is too short for is null.
    """
    shapes = {(h.count(".") + 1, len(p)) for h, p, _ in rules}
    keys = []
    for labels, length in sorted(shapes, reverse=True):
        suffix = F.substring_index(host, ".", -labels)
        whole = (F.length(F.regexp_replace(suffix, "[^.]", "")) == labels - 1) & (F.length(path) >= length)
        keys.append(F.when(whole, F.concat(suffix, F.substring(path, 1, length))))
    return keys


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, default: str = "allow", bits_per_key: float = BITS_PER_KEY, hashes: int = HASHES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule wins (equal
    length: the longer host). ``rule`` is null where none fits, and ``verdict`` is then ``default``: such a url is in
    no list. Null urls have empty host and path. Repeated rows stay; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path})
    keys = rule_keys(F.col("host"), F.col("path"), rules)
    universe = pages.select(F.explode(F.array(*keys)).alias("key")) if keys else None
    listed = {v: [h + p for h, p, w in rules if w == v] for v in sorted({r[2] for r in rules})}
    fits = []
    for i, (verdict, names) in enumerate(listed.items()):
        cascade = Cascade.build(spark.createDataFrame([(k,) for k in names], "key string"), universe, bits_per_key, hashes, first_seed=1 + 100 * i)
        fits += [F.when(cascade.contains(k), F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("rule"), F.lit(verdict).alias("verdict"))) for k in keys]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>")
    out = pages.withColumn("__best", best)
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(default))}).drop("__best")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path
  FROM r
), x AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM x
"""

"""String column expressions: channel roles, wells, loci, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First match wins. Fixed values.
POPULATIONS = ((r"\bCD3\b", "T cells"), (r"\bCD19\b|\bCD20\b", "B cells"), (r"\bCD56\b|\bCD16\b", "NK cells"), (r"\bCD14\b", "Monocytes"), (r"\bCD45\b", "Leukocytes"))


def clean_cell(x: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.trim(x)
    return F.when(t != "", t)


def channel_role(label: Column) -> Column:
    """scatter, time, igg or marker, by the label's words."""
    name = F.upper(F.coalesce(label, F.lit("")))
    return (
        F.when(name.rlike(r"(^|[^A-Z])(FSC|SSC)"), "scatter").when(name.rlike(r"(^|[^A-Z])TIME([^A-Z]|$)"), "time")
        .when(name.rlike(r"IGG|(^|[^A-Z])ISO"), "igg").otherwise("marker")
    )


def population_of(marker: Column, rules=POPULATIONS) -> Column:
    out = F.lit("Unknown")
    for pattern, name in reversed(rules):
        out = F.when(F.upper(marker).rlike(pattern), name).otherwise(out)
    return F.when(marker.isNull(), "Unknown").otherwise(out)


def scatter_channel(label: Column) -> Column:
    """Trimmed, upper case, underscores as hyphens."""
    return F.upper(F.translate(F.trim(label), "_", "-"))


def safe_name(label: Column) -> Column:
    """Blanks, slashes and hyphens as underscores."""
    return F.regexp_replace(label, "[ /-]", "_")


def well_id(x: Column) -> Column:
    """``A1`` for ``a1``, ``1A``, ``A 01``; null for what is no well."""
    t = F.upper(F.regexp_replace(x, r"\s", ""))
    letter = F.coalesce(F.nullif(F.regexp_extract(t, r"^([A-Z])0*(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^0*(\d+)([A-Z])$", 2), F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"^([A-Z])0*(\d+)$", 2), F.lit("")), F.nullif(F.regexp_extract(t, r"^0*(\d+)([A-Z])$", 1), F.lit("")))
    return F.concat(letter, number)


def locus(header: Column) -> Column:
    """Locus name of a column header: no quotes or colons, nothing behind ``*``, DRB as DRB1."""
    t = F.upper(F.trim(F.regexp_replace(F.regexp_replace(header, "[\"':]", ""), r"\*.*$", "")))
    return F.when(t == "DRB", "DRB1").when(t == "DQB", "DQB1").when(t == "CW", "C").otherwise(F.nullif(t, F.lit("")))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def inside(path: Column) -> Column:
    """Whether a relative path stays below its folder."""
    p = F.translate(path, "\\", "/")
    return ~(p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike("^[A-Za-z]:"))


def natural_key(name: Column) -> Column:
    """Sort key that orders digits as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def rgb_channel(name: Column) -> Column:
    """red, green or blue if exactly one such token stands in a file name."""
    tokens = F.filter(F.split(F.lower(stem(name)), "[^a-z0-9]+"), lambda t: t.isin("r", "red", "g", "green", "b", "blue"))
    first = F.substring(F.get(tokens, F.lit(0)), 1, 1)
    return F.when(F.size(tokens) == 1, F.when(first == "r", "red").when(first == "g", "green").otherwise("blue"))


def params_json(params: Column) -> Column:
    """A map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


#: Metadata keys that may hold a tube's name, best first. Fixed values.
TUBE_KEYS = ("$tube name", "tube name", "$tubename", "tubename", "tube", "tube name:", "sample name", "$sample", "sample", "$src", "src", "name")


def _plain_key(key: Column) -> Column:
    return F.translate(F.lower(F.trim(key)), "_-", "  ")


def tube_name(meta: Column, fallback: Column) -> Column:
    """Name of a tube from a map of metadata: the first known key that has a value, however the key is written.

    Of keys that differ only in case, blanks, hyphens or underscores the last one with a value counts.
    """
    entries = F.filter(F.transform(F.map_entries(meta), lambda e: F.struct(_plain_key(e["key"]).alias("k"), F.trim(e["value"]).alias("v"))), lambda e: e["v"] != "")
    last = lambda k: F.try_element_at(F.filter(entries, lambda e: e["k"] == k), F.lit(-1))["v"]
    return F.coalesce(*map(last, TUBE_KEYS), fallback)


def positive_marker(label: Column) -> Column:
    """First marker with a ``+`` channel of a label like ``CD3 PerCP-A+ CD19 APC-Cy7-A-``; null if there is none.

    Words are paired from the left: one that ends with ``+`` or ``-`` is the channel of the word before it, unless that
    one is a channel already.
    """
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(None).cast("string").alias("marker"), F.lit(None).cast("string").alias("found"))

    def step(state: Column, word: Column) -> Column:
        pair = state["marker"].isNotNull() & word.rlike(r"[+-]$")
        found = F.when(pair & word.endswith("+"), F.coalesce(state["found"], state["marker"])).otherwise(state["found"])
        return F.struct(F.when(~pair, word).alias("marker"), found.alias("found"))

    return F.aggregate(words, start, step, lambda s: s["found"])


def canonical_metric(name: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Canonical name of a metric: case, hyphens and blanks don't matter; unknown names come back in plain form."""
    def plain(text: str) -> str:
        return text.casefold().replace("-", "_").replace(" ", "_")

    low = F.translate(F.lower(F.trim(name)), "- ", "__")
    pairs = [F.lit(x) for canonical, names in aliases.items() for a in dict.fromkeys(plain(n) for n in (canonical, *names)) for x in (a, canonical)]
    known = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(known, low), F.nullif(low, F.lit("")))


#: Gates that come first in a report. Fixed values.
FIRST_GATES = ("All Cells", "Singlets", "Lymphocytes")


def gate_rank(gate: Column) -> Column:
    """What gates are ordered by: the three broad ones first, then by name whatever its case."""
    rank = F.array_position(F.array(*map(F.lit, FIRST_GATES)), gate) - 1
    return F.struct(F.when(rank >= 0, rank).otherwise(len(FIRST_GATES)).alias("rank"), F.lower(gate).alias("name"))


def formatted(x: Column, digits: int = 2, suffix: str = "") -> Column:
    """A number with fixed digits, ``-`` if it is missing or not finite."""
    v = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return F.when(v.isNull(), "-").otherwise(F.concat(F.format_string(f"%.{digits}f", v.cast("double")), F.lit(suffix)))


def percent_with_range(value: Column, low: Column, high: Column, span: Column, digits: int = 1) -> Column:
    """A percentage with its range behind it: both ends if they are known, else the width, else alone."""
    main = formatted(value, digits, "%")
    both = F.concat(main, F.lit(" (range: "), formatted(low, digits), F.lit("-"), formatted(high, digits, "%)"))
    width = F.concat(main, F.lit(" (range: "), formatted(span, digits, "%)"))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    return F.when(known(low) & known(high), both).when(known(span), width).otherwise(main)


def decoded(data: Column) -> Column:
    """Bytes as trimmed text: UTF-8, or Latin-1 where that is not valid; null is empty."""
    return F.trim(F.coalesce(F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1")), F.lit("")))

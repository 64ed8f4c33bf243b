"""Toxicity by maximum-scoring segments.

Tokens score their log-odds between toxic and other labelled documents, with an informative Dirichlet prior (the
corpus's own frequencies) and shrunk by their standard error; tokens of no significance score a small negative drift.
Inflected words share a stem, so the heads of a token count as tokens too and its best known one scores.
One linear scan then finds all maximal scoring segments of a text. Their scores follow an extreme-value law in clean
text: with its parameter lambda, the root of sum p * exp(lambda * s) = 1, and a constant K, a segment of score S in n
tokens is expected K * n * exp(-lambda * S) times. What significant segments have in excess of that adds up to a
document's evidence, and a logistic curve on all training rows turns evidence into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import exact_quantiles
from .common import materialize, remove_scratch, slices, spread, table
from .labelled import held_out, trainable, with_labels
from .shingles import mix, powers

#: Least z-score and toxic documents of a token that may score above the drift, and prior pseudo-documents.
LEAST_Z, LEAST_DOCS, PRIOR = 4.0, 5, 20.0
#: Standard errors by which log-odds are shrunk, and what must remain: weaker ones tell languages and topics apart.
SHRINK, LEAST_ODDS = 2.0, 2.0
DRIFT = -0.05
#: Bytes of the token heads.
HEADS = (4, 5, 6, 7, 8)
#: Expected number of chance segments below which one counts as significant, and the score at which a text is toxic.
SIGNIFICANT, TOXIC = 0.05, 0.7

#: Token bytes: letters (A-Z as a-z) and everything beyond ASCII.
_VALUE = np.random.default_rng(31).integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CHUNK = 1 << 19


def tokens(texts: list[str | None]):
    """(start, end, hashes) of the tokens of each text, in bytes; texts are hashed a chunk at a time.

    ``hashes`` has a column for the whole token and one for each head; a token too short for a head has 0 there.
    """
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size < _CHUNK):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        edges = np.flatnonzero(np.diff(_IS_TOKEN[data], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:-1], out=sums[1:])
        hashes = np.zeros((1 + len(HEADS), len(starts)), np.uint64)
        hashes[0] = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        for i, n in enumerate(HEADS):
            long = np.flatnonzero(ends - starts > n)
            hashes[1 + i, long] = mix((sums[starts[long] + n] - sums[starts[long]]) * down[starts[long]] + np.uint64(1000 + n))
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        first = np.searchsorted(starts, offsets)
        for i in range(len(parts)):
            a, b = first[i], first[i + 1]
            yield starts[a:b] - offsets[i], ends[a:b] - offsets[i], hashes[:, a:b]


def token_texts(texts: list[str | None]) -> list[str]:
    """Every text's different tokens in the order they come, as a text: it has the same hashes as the whole."""
    out = []
    for text, (starts, ends, hashes) in zip(texts, tokens(texts), strict=True):
        raw, first = (text or "").encode("utf-8", "surrogatepass"), np.sort(np.unique(hashes[0], return_index=True)[1])
        out.append(b" ".join([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
    return out


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of document frequencies with a Dirichlet prior of the corpus's shape, and their z-scores."""
    share = (toxic + other + 0.5) / (n_toxic + n_other + 1)
    a, b = toxic + prior * share, other + prior * share
    odds = np.log(a / np.maximum(n_toxic + prior - a, 0.5)) - np.log(b / np.maximum(n_other + prior - b, 0.5))
    return odds, odds / np.sqrt(1 / a + 1 / b)


def maximal_segments(where: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by one scan with a stack.

    Only tokens that score above zero are passed (their places and scores); the tokens between score ``drift`` each.
    """
    segments: list[list] = []  # first, last, total before it, total behind it
    total, last = 0.0, -1
    for w, s in zip(where.tolist(), score.tolist(), strict=True):
        total += drift * (w - last - 1)
        new = [w, w, total, total + s]
        total += s
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= new[2]:
                j -= 1
            if j < 0 or segments[j][3] >= new[3]:
                break
            new = [segments[j][0], new[1], segments[j][2], new[3]]
            del segments[j:]
        segments.append(new)
        last = w
    return [(a, b, r - l) for a, b, l, r in segments]


class ToxicSegments:
    """Token scores, extreme-value parameters and the curve from evidence to score."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, drift: float = DRIFT):
        order = np.argsort(hashes)
        self.hashes, self.scores, self.drift = hashes[order], scores[order], drift
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.rate, self.k = 1.0, 1.0
        self.slope, self.offset = 0.0, 0.0

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the tokens that score above the drift."""
        if not len(self.hashes) or not hashes.shape[1]:
            return np.empty(0, np.int64), np.empty(0)
        unit, where = np.nonzero(self._maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        h = hashes[unit, where]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        best = np.zeros(hashes.shape[1])
        np.maximum.at(best, where[known], self.scores[at[known]])
        where = np.flatnonzero(best)
        return where, best[where]

    def calibrate(self, clean: DataFrame) -> None:
        """Extreme-value parameters from clean documents: tokens (n), scores of their hits and of their maximal segments."""
        n = (clean.agg(F.sum("n")).first()[0] or 0) + 1
        # the hits' scores are scores of the model's tokens
        hits = clean.select(F.explode("hits").alias("s")).groupBy("s").count().toPandas().sort_values("s")
        # every scored token has been seen half a time more than it was: the law needs some background
        s = np.concatenate([hits["s"].to_numpy(float), self.scores])
        p = np.concatenate([hits["count"].to_numpy(float), np.full(len(self.scores), 0.5 / max(1, len(self.scores)))]) / n
        if not len(s):
            return
        lo, hi = 0.0, 50.0
        for _ in range(80):
            mid = (lo + hi) / 2
            value = (p * np.exp(np.minimum(mid * s, 500))).sum() + (1 - p.sum()) * np.exp(mid * self.drift)
            lo, hi = (mid, hi) if value < 1 else (lo, mid)
        self.rate = max(lo, 0.1)
        # K: so that clean text has as many segments above the median as the law expects
        seen = clean.select(F.explode("segments").alias("s"))
        found = exact_quantiles(seen, [], "s", [0.5])
        row = found.first()
        remove_scratch(found)
        if row is not None:
            self.k = float(np.clip(seen.where(F.col("s") >= row.x).count() / (n * np.exp(-self.rate * row.x)), 1e-6, 1.0))
        else:
            self.k = 1.0 / n

    def significant(self, n: int, where: np.ndarray, score: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments of n tokens: first and last token, evidence (the excess over chance, in nats)."""
        chance = np.log(max(self.k * max(1, n), 1e-9))
        found = ((a, b, self.rate * s - chance) for a, b, s in maximal_segments(where, score, self.drift))
        return [(a, b, float(x)) for a, b, x in found if x >= -np.log(SIGNIFICANT)]

    def passages(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant passages of a text: first byte, end, evidence."""
        return [(int(starts[a]), int(ends[b]), x) for a, b, x in self.significant(len(starts), *self.hits(hashes))]

    def fit_curve(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic curve on log(1 + evidence), from numbers of documents."""
        x, w = np.stack([np.ones(len(y)), x], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
            w += np.clip(step, -2, 2)
        self.offset, self.slope = float(w[0]), float(max(0.0, w[1]))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(evidence), -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicSegments:
    """Fit on all labelled rows, none of them held out.

    Whole texts stay where they are read. Of a text, its different tokens meet its label to be counted, and what its
    segments score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ids, texts = trainable(docs, id_col, text_col).select("id"), spread(trainable(docs, id_col, text_col))

    def sets(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(token_texts(b.column(1).to_pylist()), pa.string())], names=["id", "tokens"])

    def distinct(batches):
        for b in slices(batches):
            y = b.column(1).to_numpy()
            sets = [np.unique(h[h > 0]) for _, _, h in tokens(b.column(0).to_pylist())]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(y, [len(s) for s in sets]))], names=["token", "y"])

    sizes = dict(with_labels(ids, labels, id_col, label).groupBy("y").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    seen = with_labels(texts.mapInArrow(sets, f"id {kind}, tokens string"), labels, id_col, label).select("tokens", "y")
    counts = seen.mapInArrow(distinct, "token long, y int").groupBy("token").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other"))

    def significant(batches):
        for b in batches:
            odds, z = log_odds(b.column("toxic").to_numpy().astype(float), b.column("other").to_numpy().astype(float), n_toxic, n_other)
            scores = odds * (1 - SHRINK / np.maximum(z, SHRINK))
            keep = (z >= LEAST_Z) & (scores >= LEAST_ODDS)
            yield pa.RecordBatch.from_arrays([b.column("token").filter(pa.array(keep)), pa.array(scores[keep])], names=["token", "score"])

    # the significant tokens: a vocabulary, which goes to every task; once it is written the shuffles behind it go
    vocabulary = materialize(counts.where(F.col("toxic") >= LEAST_DOCS).mapInArrow(significant, "token long, score double"), "toxic-tokens")
    kept = vocabulary.toPandas().sort_values("token")
    remove_scratch(vocabulary)
    model = ToxicSegments(kept["token"].to_numpy(np.int64).view(np.uint64), kept["score"].to_numpy(float))

    def found(batches):
        for b in slices(batches):
            rows = []
            for _, _, h in tokens(b.column(1).to_pylist()):
                where, score = model.hits(h)
                rows.append((h.shape[1], score.tolist(), [x for *_, x in maximal_segments(where, score, model.drift)]))
            n, hits, segments = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.float64())), pa.array(segments, pa.list_(pa.float64()))], names=["id", "n", "hits", "segments"])

    # a row per labelled document with scores only
    scored = texts.mapInArrow(found, f"id {kind}, n long, hits array<double>, segments array<double>")
    rows = materialize(with_labels(scored, labels, id_col, label), "toxic-hits")
    model.calibrate(rows.where("y = 0"))
    chance = F.log(F.greatest(model.k * F.greatest("n", F.lit(1)), F.lit(1e-9)))
    excess = F.filter(F.transform("segments", lambda s: model.rate * s - chance), lambda x: x >= float(-np.log(SIGNIFICANT)))
    x = F.log1p(F.aggregate(excess, F.lit(0.0), lambda a, b: a + b))
    # documents are counted by evidence to a 4096th
    counts = rows.groupBy(F.round(x * 4096).alias("x"), "y").count().toPandas().sort_values(["y", "x"])
    if len(counts):
        model.fit_curve(counts["x"].to_numpy(float) / 4096, counts["y"].to_numpy(int), counts["count"].to_numpy(float))
    remove_scratch(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicSegments, id_col: str = "doc_id", text_col: str = "text", threshold: float = TOXIC, carry: bool = False) -> DataFrame:
    """id, held_out, score, predicted, passages (first byte, end, evidence) for every row of ``docs``.

    With ``carry`` the other columns of ``docs`` besides (a clashing name is the operator's). Only the text is an input; null and empty texts have no
    passage. A null id is not held out; repeated rows are scored alike; an empty table gives no rows.
    """
    own = ["held_out", "score", "predicted", "passages"]
    extra = [c for c in docs.columns if c not in (id_col, *own)] if carry else []
    rows = docs.select(id_col, *extra, held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        for b in slices(batches):
            found = [model.passages(*t) for t in tokens(b.column(b.num_columns - 1).to_pylist())]
            score = model.score(np.array([sum(x for _, _, x in f) for f in found]))
            arrays = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array([[{"start": a, "stop": e, "evidence": x} for a, e, x in f] for f in found], passage)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], *own[1:]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", score double, predicted int, passages array<struct<start:bigint,stop:bigint,evidence:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = TOXIC, **options) -> DataFrame:
    """``docs`` without its toxic rows; columns stay, whatever they are called.

    Rows that repeat, or share an id or have none, are judged each by their text; null and empty texts are judged as texts
    without passages; an empty table stays empty. Labels of ids that ``docs`` lacks say nothing.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("__row"))
    return score_toxicity(rows, model, "id", "text", threshold, carry=True).where("predicted = 0").select("__row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(spread(docs.select("doc_id", "text")), model).select("doc_id", "held_out", "score", "predicted")

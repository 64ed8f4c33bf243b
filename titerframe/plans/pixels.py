"""Pixel-table, matching, model and stream queries."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..operators import models, sampling, spatial
from ..streaming import progress as S
from .proxies import events, table

IMG = ["image"]

#: Labelled rows that votes are taken from at most.
TRAINING = 20_000


def _pixels(spark, sf_dir, shift: int = 0):
    """Label maps of 40 x 40 from line items: the smallest part key of a place labels it."""
    li = table(spark, sf_dir, "lineitem")
    px = li.groupBy((F.col("l_suppkey") % 8).alias("image"), (F.col("l_orderkey") % 40).alias("y"), ((F.col("l_partkey") + shift) % 40).alias("x")).agg(F.min("l_partkey").alias("k"), F.avg("l_quantity").alias("v"))
    blob = F.floor(F.col("y") / 8) * 5 + F.floor(F.col("x") / 8) + 1
    return px.select("image", "y", "x", F.when(F.col("k") % 3 == 0, 0).otherwise(blob).cast("long").alias("label"), F.col("v").alias("r"))


def _px(name: str, shift: int = 0) -> str:
    return f"{name} AS (SELECT image, y, x, CASE WHEN k % 3 = 0 THEN 0 ELSE y // 8 * 5 + x // 8 + 1 END AS label, v AS r FROM (SELECT l_suppkey % 8 AS image, l_orderkey % 40 AS y, (l_partkey + {shift}) % 40 AS x, min(l_partkey) AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3))"


def region_means(spark, sf_dir):
    m = spatial.region_means(_pixels(spark, sf_dir), IMG, ["r"])
    return m.withColumn("mean_r", F.round("mean_r", 6))


def centroids(spark, sf_dir):
    c = spatial.centroids(_pixels(spark, sf_dir), IMG)
    return c.withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


def border(spark, sf_dir):
    return spatial.border_labels(_pixels(spark, sf_dir), IMG)


def adjacency(spark, sf_dir):
    return spatial.adjacent_labels(_pixels(spark, sf_dir), IMG, 40, 40)


def overlaps(spark, sf_dir):
    o = spatial.overlaps(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)
    return o.withColumns({"iou": F.round("iou", 6), "dice": F.round("dice", 6)})


def pixel_scores(spark, sf_dir):
    return spatial.pixel_scores(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)


def focus(spark, sf_dir):
    f = spatial.focus(_pixels(spark, sf_dir), IMG, "r")
    return f.withColumns({c: F.round(c, 5) for c in ("laplacian_var", "mean", "sd", "saturated")})


def features(spark, sf_dir):
    f = spatial.image_features(_pixels(spark, sf_dir).withColumn("r", F.col("r") / 50), IMG, "r")
    return f.withColumns({c: F.round(c, 6) for c in f.columns if c != "image"})


def nearest(spark, sf_dir):
    c = spatial.centroids(_pixels(spark, sf_dir), IMG)
    return spatial.nearest_centroid(c, IMG, 12.0).withColumn("nearest", F.round("nearest", 6))


def labels_at(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("image"), F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % 40).alias("py"), (F.col("o_custkey") % 40).alias("px"))
    return spatial.label_at(points, _pixels(spark, sf_dir), IMG, 2).select("image", "point", "label")


def circles(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("image"), F.col("s_suppkey").alias("label"), (F.col("s_suppkey") * 7 % 40).cast("double").alias("cy"), (F.col("s_suppkey") * 11 % 40).cast("double").alias("cx"), F.lit(2.5).alias("radius"))
    return spatial.rasterise(c, IMG)


def stitching(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    tiles = p.select("image", F.explode(F.array(*[F.struct(F.lit(a).alias("y0"), F.lit(b).alias("x0"), F.lit(w).alias("gain")) for a, b, w in ((0, 0, 1.0), (8, 8, 2.0))])).alias("t"), "y", "x", "r")
    tiles = tiles.select("image", F.col("t.y0").alias("y0"), F.col("t.x0").alias("x0"), (F.col("y") - F.col("t.y0")).alias("ty"), (F.col("x") - F.col("t.x0")).alias("tx"), (F.col("r") * F.col("t.gain")).alias("v")).where("ty >= 0 AND tx >= 0 AND ty < 32 AND tx < 32")
    return spatial.stitched(tiles, IMG, "v").withColumn("v", F.round("v", 6))


def matching(spark, sf_dir):
    o = spatial.overlaps(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)
    return spatial.match_pairs(o, IMG, "t", "p", "iou", 0.05).withColumn("iou", F.round("iou", 6))


def matching_greedy(spark, sf_dir):
    o = spatial.overlaps(_pixels(spark, sf_dir), _pixels(spark, sf_dir, 3), IMG)
    return spatial.match_pairs(o, IMG, "t", "p", "iou", 0.05, greedy=True).withColumn("iou", F.round("iou", 6))


def marker_calibration(spark, sf_dir):
    ev = events(spark, sf_dir)
    long = ev.select("file_id", "l_orderkey", "l_linenumber", "cd3", "cd19").unpivot(["file_id", "l_orderkey", "l_linenumber"], ["cd3", "cd19"], "marker", "value")
    pool = sampling.pool_per_group(long, ["marker"], ["file_id"], ["l_orderkey", "l_linenumber"], per_part=5000, total=120_000)
    return models.calibrate_markers(pool, "marker", "value").withColumns({"cofactor": F.round("cofactor", 4), "threshold": F.round("threshold", 4)})


def cluster_labels(spark, sf_dir):
    ev = events(spark, sf_dir).select((F.col("l_orderkey") % 12).alias("cluster"), "fsc_a", "ssc_a", F.asinh(F.col("cd3") / 150).alias("cd3"), F.asinh(F.col("cd19") / 150).alias("cd19"))
    return models.label_clusters(ev, "cluster", {"cd3": 1.0, "cd19": 1.2}, "fsc_a", "ssc_a", least_share=0.5)


def knn_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    training = e.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id")).limit(TRAINING)
    return models.neighbour_vote(e, training, "vec_id", "embedding", "label", k=5, without_self=True)


def kmeans(spark, sf_dir):
    ev = events(spark, sf_dir).select("file_id", "fsc_a", "ssc_a", "cd3", "cd19")
    return models.cluster_vectors(ev, ["fsc_a", "ssc_a", "cd3", "cd19"], 6).groupBy("cluster").agg(F.count("*").alias("n"))


def progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.progress(e, "user_id", "event_type", "ts")


def tumbling(spark, sf_dir):
    t = S.tumbling(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour", "value")
    return t.withColumn("total", F.round("total", 6))


def sliding(spark, sf_dir):
    t = S.sliding(table(spark, sf_dir, "events"), ["event_type"], "ts", "2 hours", "1 hour", "value")
    return t.withColumn("total", F.round("total", 6))


def sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


def first_items(spark, sf_dir):
    return S.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


def expiry(spark, sf_dir):
    return S.expired(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-31 00:00:00", 24)


def eviction(spark, sf_dir):
    jobs = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 101).alias("size"), F.col("s_suppkey").alias("at"))
    return S.evictions(jobs, "size", "at", 1000).select("s_suppkey", "size")


def streamed_counts(spark, sf_dir):
    """The hourly counts again, by a stream over the table's files that ends when they are read."""
    name = f"progress_{zlib.crc32(sf_dir.encode())}"
    stream = S.tumbling(S.read_table_stream(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour", "value", watermark=None)
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumn("total", F.round("total", 6))


_T = "SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"
_OV = f"""WITH {_px('a')}, {_px('b', 3)}, i AS (SELECT a.image, a.label AS t, b.label AS p, count(*) AS inter FROM a JOIN b USING (image, y, x) WHERE a.label > 0 AND b.label > 0 GROUP BY 1, 2, 3),
ta AS (SELECT image, label AS t, count(*) AS t_area FROM a WHERE label > 0 GROUP BY 1, 2), pa AS (SELECT image, label AS p, count(*) AS p_area FROM b WHERE label > 0 GROUP BY 1, 2)"""
_STEPS = "(VALUES (0, 1), (1, -1), (1, 0), (1, 1)) s(dy, dx)"
QUERIES = {
    "agg_region_means": (region_means, f"WITH {_px('a')} SELECT image, label, count(*) AS area, round(avg(r), 6) AS mean_r FROM a WHERE label > 0 GROUP BY image, label"),
    "val_centroids": (centroids, f"WITH {_px('a')} SELECT image, label, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, count(*) AS area FROM a WHERE label > 0 GROUP BY image, label"),
    "sg_border_labels": (border, f"WITH {_px('a')}, m AS (SELECT image, max(y) AS y1, max(x) AS x1, min(y) AS y0, min(x) AS x0 FROM a GROUP BY image) SELECT DISTINCT image, label FROM a JOIN m USING (image) WHERE label > 0 AND (y IN (y0, y1) OR x IN (x0, x1))"),
    "sg_adjacent_labels": (adjacency, f"WITH {_px('a')} SELECT DISTINCT p.image AS image, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM a p CROSS JOIN {_STEPS} JOIN a q ON q.image = p.image AND q.y = (p.y + dy + 40) % 40 AND q.x = (p.x + dx + 40) % 40 WHERE p.label > 0 AND q.label > 0 AND p.label <> q.label"),
    "jn_region_overlaps": (overlaps, f"{_OV} SELECT image, t, p, inter, t_area, p_area, round(inter / (t_area + p_area - inter), 6) AS iou, round(2 * inter / (t_area + p_area), 6) AS dice FROM i JOIN ta USING (image, t) JOIN pa USING (image, p)"),
    "val_pixel_scores": (pixel_scores, f"WITH {_px('a')}, {_px('b', 3)}, j AS (SELECT image, coalesce(a.label > 0, false) AS t, coalesce(b.label > 0, false) AS p FROM a FULL JOIN b USING (image, y, x)) SELECT image, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY image"),
    "sg_focus": (focus, f"WITH {_px('a')}, n AS (SELECT a.image, a.y, a.x, sum(b.r) AS s, count(*) AS k FROM a JOIN a b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3) SELECT a.image AS image, round(var_pop(s - 4 * r) FILTER (k = 4), 5) AS laplacian_var, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS sd, round(avg((r >= 1.0)::INT), 5) AS saturated FROM a LEFT JOIN n USING (image, y, x) GROUP BY a.image"),
    "agg_image_features": (features, f"WITH {_px('a0')}, a AS (SELECT image, r / 50 AS r FROM a0), m AS (SELECT image, avg(r) AS mu, stddev_pop(r) AS sd FROM a GROUP BY image) SELECT a.image AS image, round(first(mu), 6) AS mean, round(first(m.sd), 6) AS sd, round(avg(((r - mu) / m.sd) ** 3), 6) AS skew, round(quantile_cont(r, 0.01), 6) AS q01, round(median(r), 6) AS q50, round(quantile_cont(r, 0.99), 6) AS q99, round(avg((r < 0.1)::INT), 6) AS dark, round(avg((r > 0.9)::INT), 6) AS bright FROM a JOIN m USING (image) GROUP BY a.image"),
    "jn_nearest_centroid": (nearest, f"WITH {_px('a')}, c AS (SELECT image, label, avg(y) AS cy, avg(x) AS cx FROM a WHERE label > 0 GROUP BY 1, 2), d AS (SELECT p.image, p.label, min(sqrt((p.cy - q.cy) ** 2 + (p.cx - q.cx) ** 2)) AS d FROM c p JOIN c q ON p.image = q.image AND p.label <> q.label GROUP BY 1, 2) SELECT c.image AS image, c.label AS label, CASE WHEN d <= 12 THEN round(d, 6) ELSE 'inf'::DOUBLE END AS nearest FROM c LEFT JOIN d USING (image, label)"),
    "jn_label_at": (labels_at, f"WITH {_px('a')}, pt AS (SELECT o_custkey % 8 AS image, o_orderkey AS point, o_orderkey % 40 AS py, o_custkey % 40 AS px FROM orders), f AS (SELECT pt.image, point, arg_min(label, ((y - py) ** 2 + (x - px) ** 2, label)) AS label FROM pt JOIN a ON a.image = pt.image AND abs(y - py) <= 2 AND abs(x - px) <= 2 WHERE label > 0 AND (y - py) ** 2 + (x - px) ** 2 <= 4 GROUP BY 1, 2) SELECT pt.image AS image, pt.point AS point, label FROM pt LEFT JOIN f USING (image, point)"),
    "val_circles": (circles, "WITH c AS (SELECT s_suppkey % 8 AS image, s_suppkey AS label, CAST(s_suppkey * 7 % 40 AS DOUBLE) AS cy, CAST(s_suppkey * 11 % 40 AS DOUBLE) AS cx FROM supplier), p AS (SELECT image, label, CAST(cy + dy AS BIGINT) AS y, CAST(cx + dx AS BIGINT) AS x, dy * dy + dx * dx AS d2 FROM c CROSS JOIN range(-3, 4) a(dy) CROSS JOIN range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 6.25) SELECT image, y, x, arg_min(label, (d2, label)) AS label FROM p GROUP BY image, y, x"),
    "val_stitching": (stitching, f"WITH {_px('a')}, t AS (SELECT image, y, x, r * g AS v FROM a CROSS JOIN (VALUES (0, 0, 1.0::DOUBLE), (8, 8, 2.0)) s(y0, x0, g) WHERE y >= y0 AND x >= x0 AND y < y0 + 32 AND x < x0 + 32) SELECT image, y, x, round(avg(v), 6) AS v, count(*) AS n_tiles FROM t GROUP BY image, y, x"),
    "jn_matching_optimal": (matching, None),
    "jn_matching_greedy": (matching_greedy, None),
    "ml_marker_calibration": (marker_calibration, None),
    "ml_cluster_labels": (cluster_labels, """WITH f AS (SELECT s_suppkey FROM supplier), ev AS (SELECT l_orderkey % 12 AS cluster, l_extendedprice AS fsc, l_quantity * 1000 AS ssc, asinh(l_tax * 5000 / 150) AS a, asinh(l_discount * 5000 / 150) AS b FROM lineitem JOIN f ON l_suppkey = s_suppkey),
q AS (SELECT quantile_cont(fsc, 0.1) AS qf, quantile_cont(ssc, 0.1) AS qs FROM ev), c AS (SELECT cluster, count(*) AS n, median(fsc) AS fsc, median(ssc) AS ssc, median(a) AS ma, median(b) AS mb, avg((a > 1.0)::INT) AS sa, avg((b > 1.2)::INT) AS sb FROM ev GROUP BY cluster),
s AS (SELECT *, CASE WHEN sa >= 0.5 AND ma >= 1.0 THEN ma - 1.0 END AS va, CASE WHEN sb >= 0.5 AND mb >= 1.2 THEN mb - 1.2 END AS vb FROM c, q)
SELECT cluster, n, CASE WHEN fsc <= qf AND ssc <= qs THEN 'Debris' WHEN va IS NULL AND vb IS NULL THEN 'Unknown' WHEN va IS NOT NULL AND vb IS NOT NULL AND abs(va - vb) < 0.10 THEN 'Unknown' WHEN vb IS NULL OR va > vb THEN 'cd3' ELSE 'cd19' END AS population FROM s"""),
    "ml_knn_vote": (knn_vote, None),
    "ml_kmeans": (kmeans, None),
    "st_progress": (progress, "SELECT user_id, count(*) AS n_events, CAST(count(DISTINCT event_type) AS INTEGER) AS n_items, max(ts) AS updated_at FROM events GROUP BY user_id"),
    "st_tumbling": (tumbling, _T),
    "st_sliding": (sliding, "WITH s AS (SELECT event_type, value, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start FROM events CROSS JOIN range(2) r(k)) SELECT event_type, start, start + INTERVAL 2 HOUR AS stop, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL"),
    "st_sessions": (sessions, "WITH b AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM g GROUP BY user_id, s"),
    "st_first_items": (first_items, "SELECT DISTINCT user_id, event_type FROM events"),
    "st_expiry": (expiry, "SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00'"),
    "st_eviction": (eviction, "WITH j AS (SELECT s_suppkey, s_suppkey * 37 % 101 AS size FROM supplier), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j) SELECT s_suppkey, size FROM b WHERE before < 1000"),
    "st_streamed_counts": (streamed_counts, _T),
}

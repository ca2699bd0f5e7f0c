"""Queries that run each operator on tables, with the SQL that must give the same rows.

The tables hold no images. Embeddings stand in for points (three components as x, y and rank, the label as the image),
events for scored points; pixel queries use pictures made of each embedding's components, or drawn for each supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motecraft.config import Config, Thresholds
from motecraft.functions import values
from motecraft.functions.numbers import rounded
from motecraft.operators import detect, report, review, spatial, trees
from motecraft.plans import images
from motecraft.sources import images as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of images."""
    e = lambda i: F.lit(300.0) * F.col("embedding")[i].cast("double")
    return _table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("seq"), e(0).alias("x"), e(1).alias("y"), e(2).alias("rank"))


POINTS = "p AS (SELECT label AS image_id, vec_id AS seq, 300.0::DOUBLE * embedding[1]::DOUBLE AS x, 300.0::DOUBLE * embedding[2]::DOUBLE AS y, 300.0::DOUBLE * embedding[3]::DOUBLE AS rank FROM embeddings)"
GREEDY = f"""
WITH {POINTS},
g AS (SELECT image_id, list({{'x': x, 'y': y, 'seq': seq}} ORDER BY -rank, seq) AS points FROM p GROUP BY image_id),
k AS (SELECT image_id, list_reduce(list_transform(points, lambda q: [q]),
        lambda acc, q: CASE WHEN len(list_filter(acc, lambda o: (o.x - q[1].x) * (o.x - q[1].x) + (o.y - q[1].y) * (o.y - q[1].y) < 121)) > 0 THEN acc ELSE list_concat(acc, q) END,
        []::STRUCT(x DOUBLE, y DOUBLE, seq BIGINT)[]) AS kept FROM g)
SELECT image_id, unnest(kept).seq AS seq FROM k"""


@query(GREEDY)
def q_nms_fold(spark, sf_dir):
    return spatial.suppress_fold(points(spark, sf_dir), Config().nms_distance)


@query(GREEDY)
def q_nms_grouped(spark, sf_dir):
    return spatial.suppress(points(spark, sf_dir), Config().nms_distance).select("image_id", "seq")


@query(GREEDY)
def q_nms_fixpoint(spark, sf_dir):
    return spatial.suppress_rounds(points(spark, sf_dir), Config().nms_distance, settle=images.settle)


_D2 = "(p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)"
_SOME = "o AS (SELECT label AS image_id, 300.0::DOUBLE * embedding[4]::DOUBLE AS x, 300.0::DOUBLE * embedding[5]::DOUBLE AS y FROM embeddings)"


def other_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second set of points of the same images."""
    e = lambda i: F.lit(300.0) * F.col("embedding")[i].cast("double")
    return _table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), e(3).alias("x"), e(4).alias("y"))



@query(f"WITH {POINTS}, {_SOME} SELECT image_id, seq FROM p WHERE EXISTS (SELECT 1 FROM o WHERE o.image_id = p.image_id AND {_D2} <= 81)")
def q_agreement_semi(spark, sf_dir):
    return spatial.near(points(spark, sf_dir), other_points(spark, sf_dir), Config().agreement_distance).select("image_id", "seq")


@query(f"WITH {POINTS}, {_SOME} SELECT image_id, seq FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image_id = p.image_id AND {_D2} < 169)")
def q_recovery_anti(spark, sf_dir):
    return spatial.far(points(spark, sf_dir), other_points(spark, sf_dir), 13.0).select("image_id", "seq")


@query(f"WITH {POINTS}, {_SOME} SELECT p.image_id, p.seq, round(sqrt(min(CASE WHEN {_D2} <= 1600 THEN {_D2} END)), 6) AS distance FROM p LEFT JOIN o ON o.image_id = p.image_id GROUP BY ALL")
def q_nearest_distance(spark, sf_dir):
    found = spatial.nearest(points(spark, sf_dir), other_points(spark, sf_dir), 40.0, row="seq")
    return found.select("image_id", "seq", F.round("distance", 6).alias("distance"))


@query(f"WITH {POINTS} SELECT image_id, seq, row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 35, 0), x, seq) AS id FROM p")
def q_reading_order_ids(spark, sf_dir):
    return spatial.numbered(points(spark, sf_dir)).select("image_id", "seq", F.col("id").cast("long").alias("id"))


@query(
    f"""WITH {POINTS}, o AS (SELECT image_id, seq, row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 35, 0), x, seq) AS id FROM p WHERE seq % 2 = 0),
n AS (SELECT image_id, seq, row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 35, 0), x, seq) AS id FROM p WHERE seq % 2 = 1),
m AS (SELECT image_id, max(id) AS last FROM o GROUP BY image_id)
SELECT image_id, seq, id, false AS suggestion FROM o UNION ALL SELECT n.image_id, seq, id + coalesce(last, 0), true FROM n LEFT JOIN m USING (image_id)"""
)
def q_proposal_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    old = spatial.numbered(p.where("seq % 2 = 0"))
    new = spatial.numbered(p.where("seq % 2 = 1"), after=old)
    both = old.withColumn("suggestion", F.lit(False)).unionByName(new.withColumn("suggestion", F.lit(True)))
    return both.select("image_id", "seq", F.col("id").cast("long").alias("id"), "suggestion")


@query(f"WITH {POINTS} SELECT image_id, seq, (floor((x + 1200) / 640))::BIGINT AS tile_x, (floor((y + 1200) / 640))::BIGINT AS tile_y FROM p")
def q_tile_assign(spark, sf_dir):
    moved = points(spark, sf_dir).withColumns({"x": F.col("x") + 1200, "y": F.col("y") + 1200})
    tx, ty = spatial.bins(F.col("x"), F.col("y"), Config().tile_size)
    return moved.select("image_id", "seq", tx.cast("long").alias("tile_x"), ty.cast("long").alias("tile_y"))


@query(
    f"""WITH {POINTS}, t AS (SELECT *, floor(x / 15) AS tx, rank AS r FROM p),
inside AS (SELECT image_id, seq, x, y FROM t WHERE x >= 15 * tx AND x < 15 * tx + 15)
SELECT image_id, count(*) AS n FROM inside GROUP BY image_id"""
)
def q_tile_interiors(spark, sf_dir):
    """Every point is in the half-open interior of exactly one of the tiles that see it."""
    wide = points(spark, sf_dir).withColumn("tile", F.explode(F.sequence(F.floor(F.col("x") / 15) - 1, F.floor(F.col("x") / 15) + 1)))
    tiles = wide.withColumns({"tile_x0": 15 * F.col("tile"), "tile_x1": 15 * F.col("tile") + 15, "tile_y0": F.floor(F.col("y") / 15) * 15, "tile_y1": F.floor(F.col("y") / 15) * 15 + 15})
    return tiles.where(detect.in_tile()).groupBy("image_id").agg(F.count("*").alias("n"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points with a status and a score."""
    status = F.when(F.col("event_type").isin("purchase", "click"), "review").otherwise("accepted")
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("id"), status.alias("status"), F.least(F.col("value") / 350.0, F.lit(1.0)).alias("score"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("reason"))


_T = Thresholds()
SCORED = f"""e AS (SELECT event_type AS image_id, event_id AS id, CASE WHEN event_type IN ('purchase', 'click') THEN 'review' ELSE 'accepted' END AS status, least(value / 350.0, 1.0) AS score, 'r' || (user_id % 3) AS reason FROM events),
d AS (SELECT *, score < {_T.priority} AS low, score < {_T.reject} AS bad, score >= {_T.accept} AS good, status = 'accepted' AS was FROM e)"""
_DECISION = "CASE WHEN was AND low THEN 'review_original_green' WHEN was THEN 'preserve_original_green' WHEN bad THEN 'reject' WHEN good THEN 'accept' ELSE 'review' END"


def _reason(reject: str) -> str:
    r = review
    return f"CASE WHEN was AND low THEN '{r.PRIORITY_TEXT}' WHEN was THEN '' WHEN bad THEN '{reject}' WHEN good THEN '{r.ACCEPT_TEXT}' ELSE '{r.UNSURE_TEXT}' END || reason AS reason, 'automatic' AS origin"


@query(f"WITH {SCORED} SELECT image_id, id, {_reason(review.REJECT_TEXT)}, {_DECISION} AS model_decision, CASE WHEN was AND NOT low OR NOT was AND NOT bad AND good THEN 'accepted' ELSE 'review' END AS status, NOT was AND bad AS removed, low AS review_priority, status AS baseline_status FROM d")
def q_decision_table(spark, sf_dir):
    return review.decide(scored_events(spark, sf_dir)).select("image_id", "id", "reason", "origin", "model_decision", "status", "removed", "review_priority", "baseline_status")


@query(f"WITH {SCORED} SELECT image_id, id, {_reason(review.PLAIN_REJECT_TEXT)}, {_DECISION} AS model_decision, CASE WHEN was AND NOT low OR NOT was AND NOT bad AND good THEN 'accepted' ELSE 'review' END AS status, NOT was AND bad AS model_rejected FROM d")
def q_decision_table_plain(spark, sf_dir):
    return review.decide_plain(scored_events(spark, sf_dir)).select("image_id", "id", "reason", "origin", "model_decision", "status", "model_rejected")


@query(
    f"""WITH {SCORED}, s AS (SELECT image_id, NOT (NOT was AND bad) AS active, CASE WHEN was AND NOT low OR NOT was AND NOT bad AND good THEN 'accepted' ELSE 'review' END AS status FROM d),
g AS (SELECT image_id, count(*) AS baseline_count, count(*) FILTER (active) AS count, count(*) FILTER (active AND status = 'review') AS review_count, count(*) FILTER (NOT active) AS model_rejected_count FROM s GROUP BY image_id)
SELECT image_id, baseline_count, count, review_count, model_rejected_count FROM g UNION ALL SELECT 'TOTAL', sum(baseline_count)::BIGINT, sum(count)::BIGINT, sum(review_count)::BIGINT, sum(model_rejected_count)::BIGINT FROM g"""
)
def q_count_report(spark, sf_dir):
    measures = ["baseline_count", "count", "review_count", "model_rejected_count"]
    summary = report.summarise(review.decide(scored_events(spark, sf_dir)))
    return report.with_total(summary, "image_id", measures).select("image_id", *measures)


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 2 = 1 THEN 'DISAGREE' END, CASE WHEN value < 20 THEN 'PALE' END, CASE WHEN value < 30 OR value > 1e9 THEN 'WEAK_RING' END,
CASE WHEN greatest(user_id % 9 + 3, 7)::DOUBLE / least(user_id % 9 + 3, 7) > 1.65 THEN 'ELONGATED' END, CASE WHEN user_id % 600 < 55 OR user_id % 600 > 500 THEN 'SIZE' END,
CASE WHEN least(value, user_id, 399 - value, 1999 - user_id) < greatest(user_id % 9 + 3, 7) / 2.0 + 2 THEN 'BORDER' END, CASE WHEN user_id % 5 = 0 AND value / 10 < 18 THEN 'NEAR_RED' END], lambda x: x IS NOT NULL), ',') AS codes FROM events"""
)
def q_review_reasons(spark, sf_dir):
    u, v = F.col("user_id"), F.col("value")
    made = _table(spark, sf_dir, "events").select(
        "event_id", (u % 2 == 0).alias("agrees"), v.alias("chroma"), (v - 10).alias("ring"), F.lit(50.0).alias("edge"), (u % 9 + 3).alias("width"), F.lit(7).alias("height"), (u % 600).alias("area"),
        v.alias("x"), u.alias("y"), F.lit(400).alias("image_width"), F.lit(2000).alias("image_height"), F.when(u % 5 == 0, v / 10).alias("red_distance"),
    )
    return made.select("event_id", F.array_join(review.reason_codes(), ",").alias("codes"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 7 AND 43 AND p_partkey % 1000 BETWEEN 30 AND 800 AND greatest(p_size, 20)::DOUBLE / least(p_size, 20) <= 2 AND (p_partkey % 1000)::DOUBLE / (p_size * 20) >= 0.5")
def q_shape_gate(spark, sf_dir):
    from motecraft.operators import detect

    shaped = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("area"), F.col("p_size").alias("width"), F.lit(20).alias("height"))
    return shaped.where(detect.shape_gate(Config())).where(F.least("width", "height") >= 7).select("p_partkey")


@query(
    """WITH b AS (SELECT CASE WHEN value < 3 THEN 0 WHEN value < 6 THEN 1 WHEN value < 9 THEN 2 WHEN value < 12 THEN 3 WHEN value < 16 THEN 4 WHEN value < 22 THEN 5 WHEN value < 32 THEN 6 END AS band, value FROM events)
SELECT band, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90, round(stddev_pop(value), 6) AS std FROM b WHERE band IS NOT NULL GROUP BY band"""
)
def q_band_stats(spark, sf_dir):
    v = F.col("value")
    return values.banded(_table(spark, sf_dir, "events"), v, v, (0, 3, 6, 9, 12, 16, 22, 32))


@query(
    """WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT label, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM p GROUP BY label)
SELECT label, round(((a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)) / greatest((a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b), 1e-6), 6) AS ratio FROM c"""
)
def q_eigen_ratio(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return e.groupBy("label").agg(F.round(values.eigen_ratio("x", "y"), 6).alias("ratio"))


@query(
    """WITH a AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), w AS (SELECT label, sqrt(x * x + y * y) AS m, ((atan2(y, x) + 2 * pi()) % pi()) * (8 / pi()) AS t FROM a),
s AS (SELECT label, floor(t)::INT % 8 AS bin, m * (1 - (t - floor(t))) AS v FROM w UNION ALL SELECT label, (floor(t)::INT + 1) % 8, m * (t - floor(t)) FROM w)
SELECT label, bin, round(sum(v), 6) AS weight FROM s GROUP BY label, bin"""
)
def q_orientation_histogram(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("gx"), F.col("embedding")[1].cast("double").alias("gy"))
    return values.orientation_histogram(e, ["label"]).select("label", "bin", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id, coalesce(sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL), false) AS member FROM documents")
def q_membership(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return report.known_members(docs, docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi"), out="member").select("doc_id", "member")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def q_duplicate_keys(spark, sf_dir):
    return report.duplicated_keys(_table(spark, sf_dir, "documents"), F.md5("text"))


@query("WITH n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '  @' WHEN 2 THEN '-' WHEN 3 THEN '+' ELSE '' END || event_type AS name FROM events) SELECT event_id, CASE WHEN regexp_matches(ltrim(name), '^[=+\\-@]') THEN '''' || name ELSE name END AS name FROM n")
def q_csv_safe(spark, sf_dir):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("=", "  @", "-", "+", "", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", report.csv_safe(F.concat(mark, "event_type")).alias("name"))


@query("(SELECT o_orderkey AS key, 'missing' AS side FROM orders EXCEPT SELECT l_orderkey, 'missing' FROM lineitem) UNION ALL (SELECT l_orderkey, 'unlisted' FROM lineitem EXCEPT SELECT o_orderkey, 'unlisted' FROM orders)")
def q_manifest_difference(spark, sf_dir):
    orders, lines = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return report.manifest_difference(orders, lines, "key")


@query(
    """WITH c AS (SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS ok, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_orderkey)
SELECT job_id, CASE WHEN ok + failed = 0 THEN 'queued' WHEN ok + failed < total THEN 'running' WHEN ok > 0 THEN 'completed' ELSE 'failed' END AS state, ok + failed AS completed, total, failed FROM c"""
)
def q_job_states(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_returnflag")
    return report.job_states(items, done=F.col("l_returnflag") == "A", failed=F.col("l_returnflag") == "R")


@query(
    r"""WITH f AS (SELECT regexp_extract(url, '^[^?#]*') || '.png' AS path FROM pages UNION ALL SELECT upper(regexp_extract(url, '^[^?#]*')) || '.gif' FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT regexp_extract(url, '^[^?#]*') || '.png' FROM pages WHERE page_id % 11 = 0),
g AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM f)
SELECT 'same stem' AS problem, min(name) AS name FROM g GROUP BY lower(regexp_replace(name, '\.[^.]*$', '')) HAVING count(*) > 1
UNION ALL SELECT 'suffix', name FROM g WHERE name LIKE '%.gif' UNION ALL SELECT 'listed twice', min(name) FROM g GROUP BY path HAVING count(*) > 1"""
)
def q_selection_conflicts(spark, sf_dir):
    """What stands against a selection of one file for each page, some of them once more in capitals or as they are."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("at"))
    paths = pages.select(F.concat("at", F.lit(".png")).alias("path"))
    paths = paths.union(pages.where("page_id % 7 = 0").select(F.concat(F.upper("at"), F.lit(".gif")))).union(pages.where("page_id % 11 = 0").select(F.concat("at", F.lit(".png"))))
    files = paths.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name")).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    return sources.conflicts(files)


@query("SELECT page_id, length(n) BETWEEN 1 AND 255 AND NOT regexp_matches(n, '[\\x00-\\x1f\\x7f/\\\\:]') AND n NOT IN ('.', '..') AND regexp_matches(lower(n), '\\.(png|html|jpg)$') AS valid FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)")
def q_file_names(spark, sf_dir):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return _table(spark, sf_dir, "pages").select("page_id", values.valid_file_name(name, ("png", "html", "jpg")).alias("valid"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(CASE WHEN event_id % 4 > 0 THEN least(value / 350.0, 1.0) END, 1.0), event_id) AS place FROM events")
def q_review_order(spark, sf_dir):
    score = F.when(F.col("event_id") % 4 > 0, F.least(F.col("value") / 350.0, F.lit(1.0)))
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("image_id"), score.alias("model_score"))
    return review.in_review_order(e).select(F.col("id").alias("event_id"), F.col("place").cast("long").alias("place"))


@query("SELECT event_type, round(avg(value) FILTER (user_id % 3 = 0) - quantile_cont(value, 0.5) FILTER (user_id % 3 <> 0), 6) AS edge FROM events GROUP BY event_type")
def q_edge_contrast(spark, sf_dir):
    edge = values.edge_contrast(F.col("value"), F.col("user_id") % 3 == 0)
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(edge, 6).alias("edge"))


@query(
    """WITH l AS (SELECT event_type, user_id % 24 AS d, min(value) AS low FROM events GROUP BY ALL)
SELECT event_type, round(quantile_cont(200.0 - low, 0.2), 6) AS depth, round(avg((200.0 - low > 199.5)::INT), 6) AS covered FROM l GROUP BY event_type"""
)
def q_rim_depth(spark, sf_dir):
    events, centre = _table(spark, sf_dir, "events"), F.lit(200.0)
    deep = values.rim_depth(events, ["event_type"], F.col("user_id") % 24, F.col("value"), centre)
    lows = events.groupBy("event_type", (F.col("user_id") % 24).alias("d")).agg((centre - F.min("value")).alias("depth"))
    share = lows.groupBy("event_type").agg(F.round(values.covered(F.col("depth"), 199.5), 6).alias("covered"))
    return deep.join(share, "event_type").select("event_type", F.round("depth", 6).alias("depth"), "covered")


@query(
    """WITH p AS (SELECT label, greatest(embedding[3]::DOUBLE, 0) AS w, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), c AS (SELECT label, sum(w * x) / greatest(sum(w), 1e-5) AS cx, sum(w * y) / greatest(sum(w), 1e-5) AS cy FROM p GROUP BY label)
SELECT label, round(sqrt(cx * cx + cy * cy), 6) AS away FROM c"""
)
def q_mass_offset(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    away = values.mass_offset(F.greatest(e(2), F.lit(0.0)), e(0), e(1))
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(away, 6).alias("away"))


@query(
    """WITH v AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS r(i)),
h AS (SELECT vec_id, sum(v * cos(i * 2 * pi() / 64 * 2)) AS a2, sum(v * sin(i * 2 * pi() / 64 * 2)) AS b2, sum(v * cos(i * 2 * pi() / 64 * 4)) AS a4, sum(v * sin(i * 2 * pi() / 64 * 4)) AS b4 FROM v GROUP BY vec_id)
SELECT vec_id, round(sqrt(a2 * a2 + b2 * b2) / 64, 6) AS harmonic2, round(sqrt(a4 * a4 + b4 * b4) / 64, 6) AS harmonic4, (SELECT min(i) FROM v WHERE v.vec_id = h.vec_id AND v.v = (SELECT min(v) FROM v AS u WHERE u.vec_id = h.vec_id)) AS lowest FROM h"""
)
def q_harmonics(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    v, turn = F.col("v").cast("double"), F.col("i") * 2 * F.pi() / 64
    return rows.groupBy("vec_id").agg(
        F.round(values.harmonic(v, turn, 2), 6).alias("harmonic2"), F.round(values.harmonic(v, turn, 4), 6).alias("harmonic4"), values.first_minimum(v, F.col("i")).cast("long").alias("lowest")
    )


@query(
    f"""WITH {SCORED}, x AS (SELECT image_id, id, CASE WHEN id % 5 = 0 THEN 'keep' WHEN id % 7 = 0 THEN 'delete' END AS edit, status FROM d)
SELECT image_id, count(*) FILTER (edit IS DISTINCT FROM 'delete') AS count, count(*) FILTER (edit IS NULL AND status = 'review') AS review_count FROM x GROUP BY image_id"""
)
def q_human_edits(spark, sf_dir):
    p = scored_events(spark, sf_dir).drop("score")
    edits = p.where("id % 5 = 0 OR id % 7 = 0").select("image_id", "id", F.when(F.col("id") % 5 == 0, "keep").otherwise("delete").alias("human_decision"))
    return report.summarise(review.corrected(p, edits)).select("image_id", "count", "review_count")


@query(
    """WITH l AS (SELECT event_type AS image_id, user_id % 40 AS id, event_id AS seq, ['undo', 'keep', 'undo', 'delete', 'keep'][(event_id * 7 + user_id) % 5 + 1] AS action FROM events),
s AS (SELECT image_id, id, list_reduce(list_transform(list(action ORDER BY seq), lambda a: [a]), lambda stack, a: CASE WHEN a[1] = 'undo' THEN stack[1 : len(stack) - 1] ELSE list_concat(stack, a) END, []::VARCHAR[]) AS stack FROM l GROUP BY ALL)
SELECT image_id, id, stack[len(stack)] AS human_decision FROM s"""
)
def q_edit_log(spark, sf_dir):
    """What stands of each point's edits after all undos."""
    action = F.element_at(F.array(*map(F.lit, ("undo", "keep", "undo", "delete", "keep"))), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int"))
    log = _table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), (F.col("user_id") % 40).alias("id"), F.col("event_id").alias("seq"), action.alias("action"))
    return review.standing_edits(log, chunk=500)


@query(
    """WITH v AS (SELECT event_id, value, event_id / 8.0::DOUBLE AS eighth, value * 1000 / 7 AS odd FROM events)
SELECT event_id, CAST(printf('%.2f', value) AS DOUBLE) AS two, CAST(printf('%.2f', eighth) AS DOUBLE) AS tie, CAST(printf('%.3f', odd) AS DOUBLE) AS three FROM v"""
)
def q_rounded(spark, sf_dir):
    """Decimals by the exact binary value, halves to even."""
    v, n = F.col("value"), F.col("event_id")
    return _table(spark, sf_dir, "events").select("event_id", rounded(v, 2).alias("two"), rounded(n / 8, 2).alias("tie"), rounded(v * 1000 / 7, 3).alias("three"))


#: Five small trees over `value` and `user_id` of events, with thresholds from the largest of both.
TREES = """SELECT tree, node, feature, CASE feature WHEN 0 THEN most_value WHEN 1 THEN most_user END * (tree + 1 + node * 3 % 5) / 12.0 AS threshold,
  CASE WHEN feature IS NOT NULL THEN node * 2 + 1 END AS "left", CASE WHEN feature IS NOT NULL THEN node * 2 + 2 END AS "right", CASE WHEN feature IS NULL THEN (tree * 7 + node * 3) % 11 / 10.0 END AS value
  FROM (SELECT *, CASE WHEN node < 3 AND NOT (node = 2 AND tree = 3) THEN (tree + node) % 2 END AS feature FROM (SELECT max(value) AS most_value, max(user_id) AS most_user FROM events), {trees}, {nodes} WHERE NOT (tree = 3 AND node > 4))"""


@query(
    f"""WITH RECURSIVE nodes AS ({TREES.format(trees="(SELECT range AS tree FROM range(5))", nodes="(SELECT range AS node FROM range(7))")}),
w AS (SELECT event_id, e.value AS f0, e.user_id::DOUBLE AS f1, t.tree, 0::BIGINT AS node FROM events e, (SELECT DISTINCT tree FROM nodes) t
  UNION ALL SELECT event_id, f0, f1, w.tree, CASE WHEN CASE n.feature WHEN 0 THEN f0 ELSE f1 END <= n.threshold THEN n."left" ELSE n."right" END FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NOT NULL)
SELECT event_id, round(avg(n.value), 9) AS score FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NULL GROUP BY event_id"""
)
def q_tree_scores(spark, sf_dir):
    """Scores of events by an ensemble whose nodes are a table."""
    events = _table(spark, sf_dir, "events")
    made = TREES.format(trees="(SELECT id AS tree FROM range(5))", nodes="(SELECT id AS node FROM range(7))").replace('"left"', "`left`").replace('"right"', "`right`").replace("FROM events", "FROM {events}").replace("12.0", "12.0D").replace("10.0", "10.0D")
    nodes = spark.sql(made, events=events).toPandas()  # a model: 33 nodes
    scored = trees.walk(events.select("event_id", "value", "user_id"), ["value", "user_id"], trees.Ensemble(nodes))
    return scored.select("event_id", F.round("score", 9).alias("score"))


@query()
def q_extra_trees(spark, sf_dir):
    """Nodes of extremely randomised trees grown on all events, with the events of both classes that are in each."""
    from motecraft.operators import extra_trees

    events = _table(spark, sf_dir, "events")
    rows = events.select(F.array(F.col("value"), F.col("user_id").cast("double"), F.hour("ts").cast("double")).alias("values"), (F.col("event_type") == F.lit("purchase")).cast("int").alias("label"))
    return spark.createDataFrame(extra_trees.grow(rows, trees=4, seed=7, min_leaf=200, settle=images.settle).astype({"feature": float, "left": float, "right": float}))


#: The 64 components of an embedding as an 8 x 8 picture of eight greys.
GREYS = """px AS (SELECT vec_id, i - 1 AS i, (i - 1) % 8 AS x, (i - 1) // 8 AS y, least(7, greatest(0, floor(4 + 16 * embedding[i]::DOUBLE)))::INT AS v FROM embeddings, range(1, 65) AS r(i))"""


def grey_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda e: F.least(F.lit(7), F.greatest(F.lit(0), F.floor(4 + 16 * e.cast("double")))).cast("int"))
    return images.pictures(_table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("grey")), "vec_id", "grey", 8)


@query(
    f"""WITH RECURSIVE {GREYS}, m AS (SELECT vec_id, t, x, y, i FROM px, range(0, 8) AS l(t) WHERE v >= t),
c(vec_id, t, x, y, label) USING KEY (vec_id, t, x, y) AS (SELECT vec_id, t, x, y, i FROM m UNION (SELECT m.vec_id, m.t, m.x, m.y, min(c.label) FROM m JOIN c ON m.vec_id = c.vec_id AND m.t = c.t AND abs(m.x - c.x) <= 1 AND abs(m.y - c.y) <= 1 JOIN recurring.c AS old ON old.vec_id = m.vec_id AND old.t = m.t AND old.x = m.x AND old.y = m.y WHERE c.label < old.label GROUP BY ALL)),
r AS (SELECT c.vec_id, c.t AS level, c.label, count(*) AS area FROM c JOIN px ON px.vec_id = c.vec_id AND px.x = c.x AND px.y = c.y GROUP BY ALL HAVING min(px.v) = c.t)
SELECT vec_id, level, area, count(*) AS n FROM r GROUP BY ALL"""
)
def q_region_areas(spark, sf_dir):
    """Areas of the nodes of the trees of bright regions, by level: regions that hold a pixel of just that level."""
    found = images.region_tree(grey_pictures(spark, sf_dir))
    return found.groupBy(F.col("image_id").cast("long").alias("vec_id"), F.col("level").cast("long").alias("level"), "area").agg(F.count("*").alias("n"))


#: Pictures of 8 x 8 pixels: an embedding's components as green, and turned by a third and two thirds as red and blue.
_BYTE = "least(255, greatest(0, floor(128 + 512 * embedding[{}]::DOUBLE)))::INT"
PIXELS = f"px AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, {_BYTE.format('i')} AS g, {_BYTE.format('(i + 20) % 64 + 1')} AS r, {_BYTE.format('(i + 41) % 64 + 1')} AS b FROM embeddings, range(1, 65) AS n(i))"


def colour_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 512 * e.cast("double")))).cast("int"))
    turned = lambda by: F.concat(F.slice("grey", by + 1, 64 - by), F.slice("grey", 1, by))
    greys = _table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("grey"))
    mixed = F.flatten(F.transform(F.arrays_zip(turned(42).alias("blue"), F.col("grey"), turned(21).alias("red")), lambda p: F.array(p["blue"], p["grey"], p["red"])))
    return images.pictures(greys.select("vec_id", mixed.alias("values")), "vec_id", "values", 8, 3)


#: Fewer threshold levels than by default, as there is an image for each supplier.
DRAWN = Config(threshold_step=60)


def drawn_pictures(spark: SparkSession, sf_dir: str, dim: bool = False) -> DataFrame:
    """An image for each supplier, with a core where its balance says."""
    at = lambda part: (F.pmod(F.floor(F.col("s_acctbal") / part), F.lit(24)) + 20).cast("int")
    return images.drawn(_table(spark, sf_dir, "supplier").select("s_suppkey", at(1).alias("x"), at(24).alias("y"), F.lit(dim).alias("dim")), "s_suppkey", "x", "y", "dim")


@query(f"WITH {PIXELS} SELECT least(r, g) - b AS chroma, count(*) AS n, min(x) AS x0, max(y) AS y1 FROM px GROUP BY 1")
def q_px_chroma(spark, sf_dir):
    px = images.measured_pixels(colour_pictures(spark, sf_dir))
    return px.groupBy(F.col("chroma").cast("long").alias("chroma")).agg(F.count("*").alias("n"), F.min("x").cast("long").alias("x0"), F.max("y").cast("long").alias("y1"))


@query(f"WITH {PIXELS} SELECT vec_id, x, y FROM px WHERE r > g + 35 AND r > b + 35 AND r > 130")
def q_px_red(spark, sf_dir):
    px = images.measured_pixels(colour_pictures(spark, sf_dir))
    return px.where("red").select(F.col("image_id").cast("long").alias("vec_id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(
    f"""WITH {PIXELS}, red AS (SELECT * FROM px WHERE r > g + 35 AND r > b + 35 AND r > 130)
SELECT px.vec_id, px.x, px.y, round(sqrt(min((px.x - red.x) * (px.x - red.x) + (px.y - red.y) * (px.y - red.y))), 6) AS distance FROM px LEFT JOIN red USING (vec_id) GROUP BY ALL"""
)
def q_px_red_distance(spark, sf_dir):
    """How far pixels are from red, within the range that matters."""
    px = images.pixels(colour_pictures(spark, sf_dir)).withColumn("id", F.col("y") * 8 + F.col("x"))
    found = spatial.nearest(px, px.where(values.is_red(Config())), float(review.RED_RANGE))
    return found.select(F.col("image_id").cast("long").alias("vec_id"), (F.col("id") % 8).cast("long").alias("x"), F.floor(F.col("id") / 8).alias("y"), F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {PIXELS}, red AS (SELECT * FROM px WHERE r > g + 35 AND r > b + 35 AND r > 130)
SELECT px.vec_id, px.x, px.y, round(sqrt(min((px.x - red.x) * (px.x - red.x) + (px.y - red.y) * (px.y - red.y))), 9) AS distance FROM px LEFT JOIN red USING (vec_id) GROUP BY ALL"""
)
def q_distance_transform(spark, sf_dir):
    """The distances of all pixels to red that detection measures candidates by."""
    found = images.red_distances(colour_pictures(spark, sf_dir))
    return found.select(F.col("image_id").cast("long").alias("vec_id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round("distance", 9).alias("distance"))


@query(f"WITH {PIXELS} SELECT level, count(*) FILTER (g > level) AS n FROM px, (SELECT range AS level FROM range(65, 256, 8)) GROUP BY level")
def q_px_threshold_levels(spark, sf_dir):
    levels = F.explode(F.sequence(F.lit(65), F.lit(255), F.lit(8))).alias("level")
    px = images.pixels(colour_pictures(spark, sf_dir)).groupBy("green").agg(F.count("*").alias("n"))
    return px.select("green", "n", levels).groupBy(F.col("level").cast("long").alias("level")).agg(F.coalesce(F.sum(F.when(F.col("green") > F.col("level"), F.col("n"))), F.lit(0)).cast("long").alias("n"))


_COMPONENTS = f"""WITH RECURSIVE {PIXELS}, m AS (SELECT vec_id, x, y FROM px WHERE g > 145 AND g < 245),
c(vec_id, x, y, label) USING KEY (vec_id, x, y) AS (SELECT vec_id, x, y, y * 8 + x FROM m UNION (SELECT m.vec_id, m.x, m.y, min(c.label) FROM m JOIN c ON m.vec_id = c.vec_id AND abs(m.x - c.x) <= 1 AND abs(m.y - c.y) <= 1 JOIN recurring.c AS old ON old.vec_id = m.vec_id AND old.x = m.x AND old.y = m.y WHERE c.label < old.label GROUP BY ALL))
SELECT vec_id, count(*) AS area, min(x) AS x0, min(y) AS y0, (max(x) - min(x) + 1) AS width, (max(y) - min(y) + 1) AS height, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM c GROUP BY vec_id, label"""


@query(_COMPONENTS)
def q_px_components(spark, sf_dir):
    found = images.components(colour_pictures(spark, sf_dir), "green", above=145, below=245)
    return found.select(F.col("image_id").cast("long").alias("vec_id"), *[F.col(c).cast("long").alias(c) for c in ("area", "x0", "y0", "width", "height")], F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query(_COMPONENTS)
def q_tiled_components(spark, sf_dir):
    """The same regions, from tiles of three pixels that are joined along their seams."""
    found = images.tiled_components(colour_pictures(spark, sf_dir), "green", above=145, below=245, size=3)
    return found.select(F.col("image_id").cast("long").alias("vec_id"), *[F.col(c).cast("long").alias(c) for c in ("area", "x0", "y0", "width", "height")], F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


@query()
def q_detect_formula_image(spark, sf_dir):
    """The whole detection on an image for each supplier."""
    return images.once_each(drawn_pictures(spark, sf_dir), lambda shown: images.detect(shown, DRAWN))


#: What a picture looks like around row 3 and column 4: mirrored at its borders without repeating them.
_AROUND = """c AS (SELECT vec_id, x, y, unnest([{'channel': 'green', 'v': g}, {'channel': 'chroma', 'v': least(r, g) - b}, {'channel': 'g_minus_r', 'v': g - r}, {'channel': 'blue', 'v': b}], recursive := true) FROM px),
m AS (SELECT i, CASE WHEN abs(i) % 14 >= 8 THEN 14 - abs(i) % 14 ELSE abs(i) % 14 END AS at FROM range(-40, 41) AS r(i)),
o AS (SELECT a.i - 3 AS dy, b.i - 4 AS dx, a.at AS y, b.at AS x, sqrt((a.i - 3) ** 2 + (b.i - 4) ** 2) AS away FROM m AS a, m AS b)"""


def _centre_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features at the middle of each embedding's picture, without blur."""
    from motecraft.operators import features

    shown = colour_pictures(spark, sf_dir)
    middle = shown.select("image_id", F.lit(1).alias("id"), F.lit(4.0).alias("x"), F.lit(3.0).alias("y"))
    return features.extract(shown, middle, sigmas=(0, 0)).select(F.col("image_id").cast("long").alias("vec_id"), F.transform("values", lambda v: F.round(v.cast("double"), 4)).alias("values"))


def _named(prefix: str, columns: dict[str, str | None]) -> Column:
    """A struct of the features `prefix` + name; null where a column has no name."""
    from motecraft.operators import features

    place = {n: i for i, n in enumerate(features.names())}
    return F.struct(*[(F.lit(None).cast("double") if n is None else F.col("values")[place[prefix + n]]).alias(c) for c, n in columns.items()])


@query(
    f"""WITH {PIXELS}, {_AROUND}, k AS (SELECT vec_id, channel, v, CASE WHEN away < 3 THEN 0 WHEN away < 6 THEN 1 WHEN away < 9 THEN 2 WHEN away < 12 THEN 3 WHEN away < 16 THEN 4 WHEN away < 22 THEN 5 ELSE 6 END AS band FROM c JOIN o USING (x, y) WHERE away < 32),
s AS (SELECT vec_id, channel, band, quantile_cont(v::DOUBLE, 0.1) AS q10, quantile_cont(v::DOUBLE, 0.5) AS q50, quantile_cont(v::DOUBLE, 0.9) AS q90, stddev_pop(v) AS std, avg(v) AS mean FROM k GROUP BY ALL)
SELECT s.vec_id, s.channel, s.band, round(q10::FLOAT::DOUBLE, 4) AS q10, round(q50::FLOAT::DOUBLE, 4) AS q50, round(q90::FLOAT::DOUBLE, 4) AS q90, round(std::FLOAT::DOUBLE, 4) AS std, CASE WHEN s.band > 0 THEN round((z.mean - s.mean)::FLOAT::DOUBLE, 4) END AS less
FROM s JOIN (SELECT vec_id, channel, mean FROM s WHERE band = 0) AS z USING (vec_id, channel)"""
)
def q_feature_bands(spark, sf_dir):
    """Quantiles, deviation and what the middle has more, by band around it, from the extracted features."""
    from itertools import pairwise

    from motecraft.operators import features

    rows = []
    for channel in features.RADIAL_CHANNELS:
        for band, (low, high) in enumerate(pairwise(features.BANDS)):
            of = {c: f"r{low}_{high}_{c}" for c in ("q10", "q50", "q90", "std")} | {"less": f"center_minus_r{band}" if band else None}
            rows.append(F.struct(F.lit(channel).alias("channel"), F.lit(band).alias("band"), _named(f"{channel}_", of).alias("of")))
    return _centre_features(spark, sf_dir).select("vec_id", F.explode(F.array(*rows)).alias("r")).select("vec_id", "r.channel", "r.band", "r.of.*")


@query(
    f"""WITH {PIXELS}, {_AROUND}, w AS (SELECT vec_id, channel, list(v ORDER BY y, x) AS vs FROM c WHERE channel IN ('green', 'chroma') GROUP BY ALL),
t AS (SELECT t, r, 32 + sin(t * (2 * pi() / 32)) * r AS yy, 32 + cos(t * (2 * pi() / 32)) * r AS xx FROM range(32) AS a(t), range(6, 20) AS b(r)),
f AS (SELECT t, yy - floor(yy) AS fy, xx - floor(xx) AS fx, floor(yy)::INT - 29 AS y0, floor(xx)::INT - 28 AS x0 FROM t),
n AS (SELECT t, fy, fx, ya.at * 8 + xa.at + 1 AS aa, ya.at * 8 + xb.at + 1 AS ab, yb.at * 8 + xa.at + 1 AS ba, yb.at * 8 + xb.at + 1 AS bb FROM f JOIN m AS ya ON ya.i = y0 JOIN m AS yb ON yb.i = y0 + 1 JOIN m AS xa ON xa.i = x0 JOIN m AS xb ON xb.i = x0 + 1),
l AS (SELECT vec_id, channel, t, min((vs[aa] * (1 - fx) + vs[ab] * fx) * (1 - fy) + (vs[ba] * (1 - fx) + vs[bb] * fx) * fy) AS low FROM w, n GROUP BY ALL),
z AS (SELECT vec_id, channel, avg(v) AS mean FROM c JOIN o USING (x, y) WHERE away < 3 GROUP BY ALL), d AS (SELECT vec_id, channel, mean - low AS d FROM l JOIN z USING (vec_id, channel)),
g AS (SELECT vec_id, channel, {", ".join(f"round(quantile_cont(d, {q / 100})::FLOAT::DOUBLE, 4) AS depth{q}" for q in (0, 10, 25, 50, 75, 90, 100))}, {", ".join(f"round(avg((d > {t})::INT)::FLOAT::DOUBLE, 4) AS deeper{t}" for t in (5, 15, 30, 60))} FROM d GROUP BY ALL),
i AS (SELECT vec_id, channel, dx, dy, v, away FROM c JOIN o USING (x, y) WHERE away < 11 AND channel IN ('green', 'chroma')), q AS (SELECT vec_id, channel, quantile_cont(v::DOUBLE, 0.25) AS low FROM i GROUP BY ALL),
h AS (SELECT vec_id, channel, dx, dy, greatest(v - low, 0) AS v FROM i JOIN q USING (vec_id, channel)), e AS (SELECT vec_id, channel, sum(v * dx) / greatest(sum(v), 1e-5) AS cx, sum(v * dy) / greatest(sum(v), 1e-5) AS cy FROM h GROUP BY ALL)
SELECT g.*, round(sqrt(cx * cx + cy * cy)::FLOAT::DOUBLE, 4) AS away11 FROM g JOIN e USING (vec_id, channel)"""
)
def q_feature_rims(spark, sf_dir):
    """How deep and how far closed the dark rim around the middle is, and how far its mass lies off, from the extracted features."""
    from motecraft.operators import features

    of = {f"depth{q}": f"trough_depth_q{q}" for q in features.DEPTH_QUANTILES} | {f"deeper{t}": f"dark_coverage_{t}" for t in features.COVERAGE} | {"away11": "center_offset_11"}
    rows = [F.struct(F.lit(channel).alias("channel"), _named(f"{channel}_", of).alias("of")) for channel in features.RADIAL_CHANNELS[:2]]
    return _centre_features(spark, sf_dir).select("vec_id", F.explode(F.array(*rows)).alias("r")).select("vec_id", "r.channel", "r.of.*")


@query()
def q_features_formula_image(spark, sf_dir):
    from motecraft.operators import features

    found = lambda shown: features.extract(shown, images.detect(shown, DRAWN).select("image_id", "id", "x", "y"))
    return images.once_each(drawn_pictures(spark, sf_dir), found)


@query()
def q_recovery_formula_image(spark, sf_dir):
    def found(shown: DataFrame) -> DataFrame:
        made = detect.candidates(shown, DRAWN)
        return detect.propose(made, detect.points_of(made, DRAWN).where("false"), DRAWN)

    return images.once_each(drawn_pictures(spark, sf_dir, dim=True), found)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of images: gates, suppression, scores, decisions, and counts with a total."""
    measures = ["baseline_count", "count", "review_count", "model_rejected_count"]
    gated = points(spark, sf_dir).where(F.col("rank") > -100)
    kept = spatial.numbered(spatial.suppress(gated, Config().nms_distance), tie="kept_order")
    scored = kept.select(F.col("image_id").cast("string").alias("image_id"), "id", F.when(F.col("rank") > 0, "accepted").otherwise("review").alias("status"), F.pmod(F.abs("rank") / 60, F.lit(1.0)).alias("score"))
    return report.with_total(report.summarise(review.decide(scored)), "image_id", measures).select("image_id", *measures)


@query(
    f"""{GREEDY.replace("SELECT image_id, unnest(kept).seq AS seq FROM k", "").replace("FROM p GROUP", "FROM p WHERE rank > -100 GROUP")}, f AS (SELECT image_id, unnest(kept).seq AS seq FROM k), j AS (SELECT f.image_id, p.rank FROM f JOIN p USING (image_id, seq)),
s AS (SELECT image_id::VARCHAR AS image_id, rank > 0 AS was, (abs(rank) / 60) % 1.0 AS score FROM j),
d AS (SELECT image_id, NOT (NOT was AND score < {_T.reject}) AS active, NOT (was AND score >= {_T.priority} OR NOT was AND score >= {_T.accept}) AS in_review FROM s),
summed AS (SELECT image_id, count(*) AS baseline_count, count(*) FILTER (active) AS count, count(*) FILTER (active AND in_review) AS review_count, count(*) FILTER (NOT active) AS model_rejected_count FROM d GROUP BY image_id)
SELECT image_id, baseline_count, count, review_count, model_rejected_count FROM summed UNION ALL SELECT 'TOTAL', sum(baseline_count)::BIGINT, sum(count)::BIGINT, sum(review_count)::BIGINT, sum(model_rejected_count)::BIGINT FROM summed"""
)
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)

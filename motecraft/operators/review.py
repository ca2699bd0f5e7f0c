"""Review reasons, statuses and the decision tables over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motecraft.config import Config, Thresholds
from motecraft.functions.numbers import rounded

#: Fixed texts of the reason codes, in the order in which they are listed.
REASON_TEXT = {
    "DISAGREE": "两种检测依据不一致",
    "PALE": "染色较淡或亮缝",
    "WEAK_RING": "暗边较弱",
    "ELONGATED": "形状偏长",
    "SIZE": "尺寸异常",
    "BORDER": "图像边缘不完整",
    "NEAR_RED": "邻近红色光晕",
}
SEPARATOR = "；"
#: Sizes that are unusual, and how near red is too near.
SIZE_RANGE, RED_RANGE = (55, 500), 18
#: Fixed texts that a decision puts before the reason at hand; a rejection's differs between the two tables.
PRIORITY_TEXT, ACCEPT_TEXT, UNSURE_TEXT = "模型与原检测不一致，需要复核；", "模型通过；", "模型仍不确定；"
REJECT_TEXT, PLAIN_REJECT_TEXT = "模型自动排除（可恢复）：疑似干扰中心；", "模型自动排除（可恢复）：疑似光晕/亮缝；"


def reason_codes(cfg: Config = Config()) -> Column:
    """The codes that apply to a candidate, in order; needs its measures and its image's `image_width`, `image_height`."""
    c = F.col
    longer, shorter = F.greatest("width", "height"), F.least("width", "height")
    tests = {
        "DISAGREE": ~c("agrees"),
        "PALE": c("chroma") < cfg.review_chroma,
        "WEAK_RING": (c("ring") < cfg.review_ring) | (c("edge") < cfg.review_edge),
        "ELONGATED": longer / shorter > cfg.review_aspect,
        "SIZE": (c("area") < SIZE_RANGE[0]) | (c("area") > SIZE_RANGE[1]),
        "BORDER": F.least(c("x"), c("y"), c("image_width") - 1 - c("x"), c("image_height") - 1 - c("y")) < longer / 2 + 2,
        "NEAR_RED": F.coalesce(c("red_distance") < RED_RANGE, F.lit(False)),
    }
    return F.filter(F.array(*[F.when(test, code) for code, test in tests.items()]), lambda x: x.isNotNull())


def reason_text(codes: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in REASON_TEXT.items() for x in kv])
    return F.array_join(F.transform(codes, lambda k: texts[k]), SEPARATOR)


def status(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, "review").otherwise("accepted")


def is_true(name: str) -> Column:
    """A missing flag is false."""
    return F.coalesce(F.col(name), F.lit(False))


def checked_score(score: Column) -> Column:
    """The score, or an error if it isn't a number from 0 to 1."""
    bad = score.isNull() | F.isnan(score) | (score < 0) | (score > 1)
    return F.when(bad, F.raise_error(F.lit("a score is not a number from 0 to 1"))).otherwise(score)


def with_optional(points: DataFrame) -> DataFrame:
    """`points` with every decision column, null where it is missing."""
    kinds = {"baseline_status": "string", "model_score": "double", "review_priority": "boolean", "model_decision": "string", "model_rejected": "boolean", "removed": "boolean", "suggestion": "boolean", "origin": "string", "human_decision": "string", "confirmed": "boolean", "reason": "string"}
    return points.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items() if k not in points.columns})


def _noted(text: str) -> Column:
    """The reason at hand after the text of a decision."""
    return F.concat(F.lit(text), F.coalesce("reason", F.lit("")))


def decide(points: DataFrame, thresholds: Thresholds = Thresholds(), score: str = "score") -> DataFrame:
    """The decision table with provenance: what people decided stays, accepted points are never removed.

    First match: a manual, decided or confirmed point is unchanged; a suggestion or removed point gets its score only;
    an accepted point goes to review below the priority threshold, else stays; a point in review is rejected below
    `reject`, accepted from `accept` on, else stays in review.
    """
    p = with_optional(points)
    checked = checked_score(F.col(score).cast("double"))
    s = F.col("_score")
    by_people = F.coalesce((F.col("origin") == "manual") | F.col("human_decision").isNotNull() | is_true("confirmed"), F.col("human_decision").isNotNull() | is_true("confirmed"))
    aside = is_true("suggestion") | is_true("removed")
    base = F.coalesce("baseline_status", "status", F.lit("review"))
    accepted = base == "accepted"
    priority, reject, accept = s < thresholds.priority_below, s < thresholds.reject, s >= thresholds.accept
    shown = rounded(s, 6)

    def pick(people: Column, suggested: Column, *rest: Column) -> Column:
        """Values of the rows of the table: accepted and low, accepted, rejected, accepted by score, left."""
        return (
            F.when(F.col("_people"), people).when(F.col("_aside"), suggested).when(accepted & priority, rest[0]).when(accepted, rest[1]).when(reject, rest[2]).when(accept, rest[3]).otherwise(rest[4])
        )

    lit = lambda v: F.lit(v)
    old = lambda name: F.col(name)
    new = {
        "status": pick(old("status"), old("status"), lit("review"), lit("accepted"), lit("review"), lit("accepted"), lit("review")),
        "model_decision": pick(old("model_decision"), old("model_decision"), lit("review_original_green"), lit("preserve_original_green"), lit("reject"), lit("accept"), lit("review")),
        "removed": pick(old("removed"), old("removed"), lit(False), lit(False), lit(True), lit(False), lit(False)),
        "model_rejected": pick(old("model_rejected"), old("model_rejected"), lit(False), lit(False), lit(True), lit(False), lit(False)),
        "reason": pick(old("reason"), old("reason"), _noted(PRIORITY_TEXT), old("reason"), _noted(REJECT_TEXT), _noted(ACCEPT_TEXT), _noted(UNSURE_TEXT)),
        "model_score": F.when(F.col("_people"), F.col("model_score")).otherwise(shown),
        "baseline_status": F.when(F.col("_people") | F.col("_aside"), F.col("baseline_status")).otherwise(base),
        "review_priority": F.when(F.col("_people") | F.col("_aside"), F.col("review_priority")).otherwise(priority),
        "origin": F.when(F.col("_people") | F.col("_aside"), F.col("origin")).otherwise("automatic"),
    }
    ready = p.withColumns({"_score": checked, "_people": by_people, "_aside": aside})
    return ready.withColumns(new).drop("_score", "_people", "_aside")


def decide_plain(points: DataFrame, thresholds: Thresholds = Thresholds(), score: str = "score") -> DataFrame:
    """The older decision table: all points are the model's to decide, the status at hand is the baseline, a rejection leaves it as it is."""
    p = with_optional(points)
    checked = checked_score(F.col(score).cast("double"))
    s, accepted = F.col("_score"), F.col("_base") == "accepted"
    priority, reject, accept = s < thresholds.priority_below, s < thresholds.reject, s >= thresholds.accept
    ready = p.withColumns({"_score": checked, "_base": F.coalesce("status", F.lit("review"))})
    return ready.withColumns(
        {
            "baseline_status": F.col("_base"),
            "model_score": rounded(s, 6),
            "review_priority": priority,
            "model_decision": F.when(accepted & priority, "review_original_green").when(accepted, "preserve_original_green").when(reject, "reject").when(accept, "accept").otherwise("review"),
            "reason": F.when(accepted & ~priority, F.col("reason")).when(accepted, _noted(PRIORITY_TEXT)).when(reject, _noted(PLAIN_REJECT_TEXT)).when(accept, _noted(ACCEPT_TEXT)).otherwise(_noted(UNSURE_TEXT)),
            "origin": F.lit("automatic"),
            "removed": ~accepted & reject,
            "model_rejected": ~accepted & reject,
            "status": F.when(accepted & priority, "review").when(accepted, "accepted").when(reject, F.col("status")).when(accept, "accepted").otherwise("review"),
        }
    ).drop("_score", "_base")


#: Edits that a log may hold beside `UNDO`, which takes back the latest edit of the same point that still stands.
EDITS, UNDO = ("keep", "delete"), "undo"
#: Places of the log that are summed up together before the sums are summed: bounds what one task orders.
CHUNK = 65_536


def standing_edits(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The edit of each point that stands after its whole log (image_id, id, seq, action): `human_decision`, or null if all were undone.

    Each point has a stack: an edit is put on it, an undo takes one off, or nothing from an empty one. The height after
    each action is a running sum less its lowest value so far, if negative; what stands is the last edit that reached
    the final height. Sums run over chunks of places first and over the chunks of a point then, so a point with many
    actions is not in one task. Places are distinct within a point. Unknown actions fail; null ones count as none.
    """
    known = F.col("action").isin(*EDITS, UNDO)
    step = F.when(F.col("action") == UNDO, -1).when(known, 1).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.col("action"))).cast("int"))
    point, part = ["image_id", "id"], ["image_id", "id", "_chunk"]
    acts = log.where("action IS NOT NULL").select(*point, "seq", "action", step.alias("_step"), F.floor(F.col("seq") / chunk).alias("_chunk"))
    inner = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    acts = acts.withColumn("_sum", F.sum("_step").over(inner)).withColumn("_low", F.min("_sum").over(inner))
    earlier = Window.partitionBy(*point).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = acts.groupBy(*part).agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_least"))
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    chunks = chunks.withColumn("_lowest", F.coalesce(F.min(F.col("_before") + F.col("_least")).over(earlier), F.lit(0))).drop("_all", "_least")
    chunks = chunks.withColumnsRenamed({c: f"_of_{c}" for c in part})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part]
    height = F.col("_before") + F.col("_sum") - F.least(F.lit(0), "_lowest", F.col("_before") + F.col("_low"))
    high = acts.join(chunks, same).select(*point, "seq", "action", "_step", height.alias("_height"))
    reached = high.groupBy(*point, "_height").agg(F.max("seq").alias("_last"), F.max_by(F.when(F.col("_step") > 0, F.col("action")), F.when(F.col("_step") > 0, F.col("seq"))).alias("_edit"))
    return reached.groupBy(*point).agg(F.max_by(F.when(F.col("_height") > 0, F.col("_edit")), "_last").alias("human_decision"))


def corrected(points: DataFrame, corrections: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Human edits: `corrections` (image_id, id, human_decision) delete or keep points, `added` are manual ones.

    Of several edits of a point the last by `seq` counts; without that column, keeping goes before deleting. A log with
    undos becomes corrections by `standing_edits`. The exact format of exported corrections is not known; this follows
    the visible effects of the edits.
    """
    last = F.max_by("human_decision", "seq") if "seq" in corrections.columns else F.max("human_decision")
    edits = corrections.groupBy("image_id", "id").agg(last.alias("_edit"))
    p = with_optional(points).join(edits, ["image_id", "id"], "left")
    keep = F.col("_edit") == "keep"
    edited = p.withColumns(
        {
            "human_decision": F.coalesce("_edit", "human_decision"),
            "removed": F.when(F.col("_edit") == "delete", True).when(keep, False).otherwise(F.col("removed")),
            "confirmed": F.when(keep, True).otherwise(F.col("confirmed")),
            "status": F.when(keep, "accepted").otherwise(F.col("status")),
        }
    ).drop("_edit")
    if added is None:
        return edited
    manual = added.withColumns({"origin": F.lit("manual"), "status": F.lit("accepted"), "confirmed": F.lit(True), "removed": F.lit(False)})
    return edited.unionByName(manual, allowMissingColumns=True)


def in_review_order(points: DataFrame, score: str = "model_score") -> DataFrame:
    """`points` with their `place` in the review of their image: the lowest score first, absent ones as 1, then by id."""
    order = Window.partitionBy("image_id").orderBy(F.coalesce(F.col(score), F.lit(1.0)), "id")
    return points.withColumn("place", F.row_number().over(order))

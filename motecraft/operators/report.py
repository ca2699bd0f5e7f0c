"""Counts per image, totals, membership of known images, and the states of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import is_true, with_optional


def summarise(points: DataFrame, keys=("image_id",)) -> DataFrame:
    """Counts of each image's points: at first, active, in review, rejected by the model, proposed."""
    p = with_optional(points)
    active = ~is_true("removed")
    return p.groupBy(*keys).agg(
        F.count_if(~is_true("suggestion") & (F.coalesce("origin", F.lit("automatic")) == "automatic")).alias("baseline_count"),
        F.count_if(active).alias("count"),
        F.count_if(active & (F.col("status") == "review")).alias("review_count"),
        F.count_if(is_true("model_rejected")).alias("model_rejected_count"),
        F.count_if(is_true("suggestion")).alias("dim_proposal_count"),
    )


def with_total(summary: DataFrame, name: str, measures: list[str]) -> DataFrame:
    """The measures by name, and a row TOTAL; names that are null stay apart from it."""
    rolled = summary.rollup(name).agg(*[F.sum(m).alias(m) for m in measures], F.grouping(name).alias("is_total"))
    return rolled.withColumn(name, F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col(name)))


def known_members(images: DataFrame, known: DataFrame, digest: str = "sha256", out: str = "used_in_model_training") -> DataFrame:
    """`images` with a flag for those whose digest is in `known`."""
    marks = known.select(digest).distinct().withColumn("_known", F.lit(True))
    return images.join(marks, digest, "left").withColumn(out, F.col("_known").isNotNull()).drop("_known")


def csv_safe(name: Column) -> Column:
    """A name that a spreadsheet takes as text: an apostrophe before what looks like a formula."""
    return F.when(F.ltrim(name).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), name)).otherwise(name)


def duplicated_keys(rows: DataFrame, key: Column, alias: str = "key") -> DataFrame:
    """Keys that more than one row has, and how many have it."""
    return rows.groupBy(key.alias(alias)).agg(F.count("*").alias("n")).where("n > 1")


def manifest_difference(listed: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = listed.select(key).distinct(), actual.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.union(b.join(a, key, "left_anti").withColumn("side", F.lit("unlisted")))


def job_states(items: DataFrame, job: str = "job_id", done: Column | None = None, failed: Column | None = None) -> DataFrame:
    """A job's state from its items: queued before any has ended, running, completed if one succeeded, else failed."""
    done, failed = done if done is not None else F.col("status") == "completed", failed if failed is not None else F.col("status") == "failed"
    counted = items.groupBy(job).agg(F.count("*").alias("total"), F.count_if(done).alias("succeeded"), F.count_if(failed).alias("failed"))
    ended = F.col("succeeded") + F.col("failed")
    return counted.select(job, job_state().alias("state"), ended.alias("completed"), "total", "failed")


def job_state() -> Column:
    """The state of a job from its counts `total`, `succeeded` and `failed`."""
    ended = F.col("succeeded") + F.col("failed")
    return F.when(ended == 0, "queued").when(ended < F.col("total"), "running").when(F.col("succeeded") > 0, "completed").otherwise("failed")


def job_message() -> Column:
    """What a job with failed images is told; null if none failed."""
    some = F.format_string("%d of %d images failed; the other results are there", "failed", "total")
    return F.when(F.col("failed") > 0, F.when(F.col("succeeded") > 0, some).otherwise("no image could be processed"))

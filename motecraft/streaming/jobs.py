"""A drop folder as a stream of jobs: admission, processing in micro-batches, states."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from motecraft.operators import report
from motecraft.sources import images

#: Most jobs waiting, and the columns a state keeps to itself.
MAX_PENDING = 3
PRIVATE = "_"


def uploads(spark: SparkSession, folder: str, files_per_batch: int = images.MAX_FILES) -> DataFrame:
    """A stream of the files that arrive in the subfolders of `folder`; a subfolder is a job."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    job = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return images.checked(images.described(files).withColumn("job_id", job))


STATES = "job_id string, total long, succeeded long, failed long, n_files long, n_bytes long, refused string, state string, message string"
#: What a job, or files of one that was admitted before, are refused with.
OVER, FULL = "the upload is over the limits of a job", "too many jobs are waiting"


@dataclass(frozen=True)
class Limits:
    """Files and bytes of one job, and (if given) how many new jobs a batch may admit."""

    files: int = images.MAX_FILES
    n_bytes: int = images.MAX_TOTAL_BYTES
    new_jobs: int | None = None


def _admission(batch: DataFrame, before: DataFrame, limits: Limits) -> DataFrame:
    """Each job of a batch with its files and bytes so far, whether it was there before, and why it is refused (or null)."""
    arrived = batch.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    old = before.select("job_id", F.col("n_files").alias("old_files"), F.col("n_bytes").alias("old_bytes"), F.col("refused").alias("old_refused"), F.lit(True).alias("old"))
    both = arrived.join(old, "job_id", "left")
    files, size = F.col("n") + F.coalesce("old_files", F.lit(0)), F.coalesce("bytes", F.lit(0)) + F.coalesce("old_bytes", F.lit(0))
    judged = both.select("job_id", files.alias("n_files"), size.alias("n_bytes"), F.coalesce("old", F.lit(False)).alias("old"), F.coalesce("old_refused", F.when((files > limits.files) | (size > limits.n_bytes), OVER)).alias("refused"))
    if limits.new_jobs is None:
        return judged
    # the first jobs by name; a bounded list, not a number for every job
    entering = judged.where("not old and refused is null").orderBy("job_id").limit(limits.new_jobs).select("job_id", F.lit(True).alias("enters"))
    waiting = ~F.col("old") & F.col("refused").isNull() & F.col("enters").isNull()
    return judged.join(entering, "job_id", "left").withColumn("refused", F.when(waiting, FULL).otherwise(F.col("refused"))).drop("enters")


def process(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], DataFrame],
    items: str,
    checkpoint: str,
    states: str | None = None,
    expected: DataFrame | None = None,
    limits: Limits | None = None,
    tell: Callable[[str], None] | None = None,
):
    """Run `handle` on the sound files of each micro-batch and append an item row per file to the table at `items`.

    `handle` returns `path` and `error` (null if the file went well); a failed file fails alone, and its message holds
    no path. Batches run one after the other. Returns the query, which ends when all that has arrived is processed.

    With a folder `states`, every batch leaves there the states of all jobs after it (`STATES`, by batch), made of those
    before it and the batch's own counts; a batch that is run again overwrites its rows. `expected` (job_id, total) says
    how many files jobs will have, else those that arrived count. With `limits` too, a job that breaks them when it first
    arrives is refused whole: it leaves no item, nor do files of it that come later; files by which an admitted job grows
    over them fail. `tell` is given a line for each batch.
    """
    if limits and not states:
        raise ValueError("limits need a folder of states, to know jobs again")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        taken = batch
        if states:
            before = states_after(spark, states, number - 1) if number else spark.createDataFrame([], STATES)
            jobs = _admission(batch, before, limits or Limits(2**62, 2**62))
            verdict = jobs.select("job_id", "old", F.col("refused").alias("job_refused"))
            known = before.select("job_id", F.col("refused").isNotNull().alias("was_refused"))
            marked = batch.join(verdict, "job_id", "left").join(known, "job_id", "left")
            leaves_none = F.col("job_refused").isNotNull() & (~F.col("old") | F.coalesce("was_refused", F.lit(False)))
            taken = marked.where(~F.coalesce(leaves_none, F.lit(False))).withColumn("error", F.coalesce("error", "job_refused")).select(*batch.columns)
        ended = handle(taken.where("error is null"), number).select("path", F.col("error").alias("failure"))
        joined = taken.select("job_id", "name", "path", "sha256", "n_bytes", "error").join(ended, "path", "left")
        error = F.coalesce("error", F.when(F.col("failure").isNotNull(), "the image could not be processed"))
        rows = joined.select("job_id", "name", "sha256", "n_bytes", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{items}/batch={number}")
        if states:
            written = spark.read.schema(rows.schema).parquet(f"{items}/batch={number}")
            _advance(before, jobs, written, expected).write.mode("overwrite").parquet(f"{states}/batch={number}")
        if tell:
            n = spark.read.schema(rows.schema).parquet(f"{items}/batch={number}").agg(F.count("*"), F.count_if(F.col("status") == "failed")).first()
            tell(f"batch {number}: {n[0]} images, {n[1]} failed")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(before: DataFrame, jobs: DataFrame, written: DataFrame, expected: DataFrame | None) -> DataFrame:
    """The states after a batch from those before it, the batch's jobs and its items."""
    made = written.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("more_succeeded"), F.count_if(F.col("status") == "failed").alias("more_failed"))
    now = jobs.select("job_id", F.col("n_files").alias("now_files"), F.col("n_bytes").alias("now_bytes"), F.when(~F.col("old"), F.col("refused")).alias("now_refused"))
    none = F.lit(0).cast("long")
    joined = before.join(now, "job_id", "full").join(made, "job_id", "left")
    counted = joined.select(
        "job_id", (F.coalesce("succeeded", none) + F.coalesce("more_succeeded", none)).alias("succeeded"), (F.coalesce("failed", none) + F.coalesce("more_failed", none)).alias("failed"),
        F.coalesce("now_files", "n_files").alias("n_files"), F.coalesce("now_bytes", "n_bytes").alias("n_bytes"), F.coalesce("refused", "now_refused").alias("refused"),
    )
    if expected is not None:
        counted = counted.join(expected.select("job_id", F.col("total").cast("long").alias("total")), "job_id", "left")
    else:
        counted = counted.withColumn("total", F.lit(None).cast("long"))
    counted = counted.withColumn("total", F.coalesce("total", "n_files"))
    told = counted.withColumns({"state": F.when(F.col("refused").isNotNull(), "refused").otherwise(report.job_state()), "message": F.coalesce("refused", report.job_message())})
    return told.select(*[c.split()[0] for c in STATES.split(", ")])


def states_after(spark: SparkSession, states: str, batch: int) -> DataFrame:
    """The states of all jobs after a batch."""
    return spark.read.schema(STATES).parquet(f"{states}/batch={batch}")


class Progress(StreamingQueryListener):
    """Keeps what the last batches of streams took: (batch, milliseconds); and why streams ended early."""

    def __init__(self, most: int = 1000) -> None:
        self.batches: deque[tuple[int, int]] = deque(maxlen=most)
        self.errors: deque[str] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches.append((event.progress.batchId, event.progress.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)


def job_items(spark: SparkSession, items: str) -> DataFrame:
    return spark.read.parquet(items)


def job_states(items: DataFrame) -> DataFrame:
    return report.job_states(items)


def admitted(states: DataFrame, most: int = MAX_PENDING) -> bool:
    """Whether another job may be queued."""
    return states.where(F.col("state").isin("queued", "running")).limit(most).count() < most


def snapshot(rows: DataFrame) -> DataFrame:
    """The public columns of a state."""
    return rows.select(*[c for c in rows.columns if not c.startswith(PRIVATE)])


def one_model(records: DataFrame, column: str = "model_sha256") -> DataFrame:
    """`records`, or an error if they name more than one model."""
    if records.select(column).distinct().limit(2).count() > 1:
        raise ValueError("a batch was scored by more than one model")
    return records

"""States of jobs after every batch against SQL, admission, and messages."""

import os

import duckdb
from pyspark.sql import functions as F

from motecraft.streaming import jobs

PARTS = 4


def split(spark, sf, folder):
    """The lines of orders as files of jobs, in four parts that arrive one after the other."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 5 = 0")
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("path"), F.lit("x.png").alias("name"), F.lit("00").alias("sha256"), F.col("l_quantity").cast("long").alias("n_bytes"),
        F.when(F.col("l_suppkey") % 7 == 0, "content is not of the suffix's format").alias("error"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % PARTS).alias("part"),
    )
    for k in range(PARTS):
        part = folder / f"{k}.parquet"
        rows.where(F.col("part") == k).toPandas().astype({"error": object}).to_parquet(part)
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return rows, stream


def handle(files, number):
    return files.select("path", F.when(F.col("flag") == "R", "lost").alias("error"))


def test_states_after_every_batch_equal_sql(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    rows, stream = split(spark, sf, tmp_path / "in")
    items, states, lines = str(tmp_path / "items"), str(tmp_path / "states"), []
    progress = jobs.Progress()
    spark.streams.addListener(progress)
    jobs.process(stream, handle, items, str(tmp_path / "cp"), states, rows.groupBy("job_id").agg(F.count("*").alias("total")), tell=lines.append).awaitTermination()
    for k in range(PARTS):
        got = {tuple(r) for r in jobs.states_after(spark, states, k).select("job_id", "state", "total", "succeeded", "failed", "message").collect()}
        want = duckdb.sql(
            f"""WITH l AS (SELECT l_orderkey::VARCHAR AS job_id, l_partkey % {PARTS} <= {k} AS here, l_suppkey % 7 = 0 OR l_returnflag = 'R' AS bad FROM '{sf}/lineitem.parquet' WHERE l_orderkey % 5 = 0),
c AS (SELECT job_id, count(*) AS total, count(*) FILTER (here AND NOT bad) AS good, count(*) FILTER (here AND bad) AS bad FROM l GROUP BY job_id HAVING count(*) FILTER (here) > 0)
SELECT job_id, CASE WHEN good + bad < total THEN 'running' WHEN good > 0 THEN 'completed' ELSE 'failed' END, total, good, bad,
  CASE WHEN bad > 0 AND good > 0 THEN bad || ' of ' || total || ' images failed; the other results are there' WHEN bad > 0 THEN 'no image could be processed' END FROM c"""
        ).fetchall()
        assert got == set(want)
    assert len(lines) == PARTS and lines[0].startswith("batch 0: ")
    spark.streams.removeListener(progress)
    assert not progress.errors


def test_a_refused_job_leaves_no_item(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    rows, stream = split(spark, sf, tmp_path / "in")
    items, states = str(tmp_path / "items"), str(tmp_path / "states")
    jobs.process(stream, handle, items, str(tmp_path / "cp"), states, limits=jobs.Limits(files=2, new_jobs=40)).awaitTermination()
    last = {r["job_id"]: r for r in jobs.states_after(spark, states, PARTS - 1).collect()}
    refused = {k for k, r in last.items() if r["state"] == "refused"}
    left = {r["job_id"]: r["n"] for r in jobs.job_items(spark, items).groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert refused and not refused & set(left) and {last[k]["message"] for k in refused} == {jobs.OVER, jobs.FULL}
    assert all(last[k]["succeeded"] + last[k]["failed"] == n for k, n in left.items())
    over = jobs.job_items(spark, items).where(F.col("error") == jobs.OVER).count()
    assert over > 0 and all(last[k]["succeeded"] <= 2 for k in left)

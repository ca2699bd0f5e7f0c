"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target words over source words. In the source's order
(size class, bucket, size, id, hash of the text) the expected copies are summed up, one offset drawn for the source is added, and the
document is taken once for each whole number its interval crosses: floor(rate) or floor(rate) + 1 times. As the order
goes by size, the words taken follow the target closely.

The running sum is built in two levels, so that a source with a third of all rows is never in one task: documents per
(source, size class, bucket) are counted and summed up over those groups, then documents are numbered within a group.

Defined cases: a null or empty text has size 0 and may be taken, for no words; a long text counts with all its words; rows
that tie in all of the order are equal texts under one id; a null source is a source of its own,
last in order; repeated rows count one by one; an empty table gives an empty result; all columns of the input are kept
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, md5_number, word_count

#: Weights that the sources take in turn, in the order of their names.
WEIGHTS = (3, 1, 2)
#: Words to take, as a share of all words, and the most of a source's words.
SHARE, LIMIT = 1.5, 2
#: Groups per source and size class: hash buckets that bound what one task numbers.
BUCKETS = 64
SEED = "mix-1"
_OFFSETS = 2**20


def _source_key(source: Column) -> Column:
    """Never null, and in the order of code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def size_class(size: Column) -> Column:
    """Eight classes for each doubling of the size at most: the bit length and the next two bits."""
    bits = F.bin(size)
    return F.length(bits) * 8 + F.conv(F.substring(F.rpad(bits, 3, "0"), 1, 3), 2, 10).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Add `target` to one row per source (`key`, `source_size`): a small table, a row for each source name.

    Targets rise in proportion to the weights until they meet their limit; what a limited source leaves over is shared
    by the others. In the order of limit / weight the limited sources come first, which gives the common level directly.
    """
    everything = Window.partitionBy()
    named = Window.orderBy("key")
    steep = Window.orderBy("ratio", "key")
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.lit(limit).cast("long") * F.col("source_size"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(steep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(steep.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / after)
    w = w.withColumn("rank", F.row_number().over(steep))
    w = w.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("first") * F.col("weight"), F.col("cap").cast("double")))
    return w.select("key", "source_size", target.alias("target"))


def plan_copies(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: `row` (the input row, or its columns `keep`), `size`, `source_size`, `target` and `copies`."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), name.alias("name"), _source_key(F.col(source)).alias("key"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"))
    base = base.withColumn("class", size_class(F.col("size"))).withColumn("bucket", md5_number(F.concat_ws("|", "name", "size"), 8) % buckets)
    group = ["key", "class", "bucket"]
    groups = materialize(base.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    per_source = source_targets(groups.groupBy("key").agg(F.sum("words").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = per_source.select("key", "source_size", "target", rate.alias("rate"), (md5_number(F.concat_ws("|", F.lit(seed), "key"), 5) / _OFFSETS).alias("offset"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(*group, F.coalesce(earlier, F.lit(0)).alias("earlier")).join(per_source, "key")
    position = F.col("earlier") + F.row_number().over(Window.partitionBy(*group).orderBy("size", "name", "tie"))
    crossed = F.floor(position * F.col("rate") + F.col("offset")) - F.floor((position - 1) * F.col("rate") + F.col("offset"))
    # a left join, as an inner one would filter on the keys first and count the words again for it
    return base.join(starts, group, "left").select("row", "size", "source_size", "target", crossed.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of `docs` as often as it is taken, with its own columns only."""
    planned = plan_copies(docs, **options).where("copies > 0")
    return planned.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits just when some value lies within r bits of both. So each distinct
fingerprint emits every value within r = 2 bits (2,081 of 64 bits), rows meet on those values, and all that meet are
linked: any two of them are within 4 bits, and a value has at most 2,081 fingerprints around it, so no group is larger.
Each links to the smallest one there, which keeps all links between groups without listing pairs.

First, fingerprints without any neighbour are set aside, by the same idea on halves: of 4 differing bits one half has
at most 2, so neighbours share a value within one bit of a half (66 rows each). A value with two fingerprints is checked
at once; where three or more meet, all of them go on. That is exact: it sets aside only fingerprints that link to none.

`one_of_each` needs a Jaccard similarity, for which pairs within the radius are only the nearest: they are verified by
their shingle sets, and an exact set join adds the links that the radius doesn't reach.

Defined cases: a null text, an empty one and one without words have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows and equal texts share a fingerprint; null ids count as the largest
id; an empty table gives an empty result; columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import set_join
from .common import discard, materialize
from .components import connected_components
from .shingles import BITS, NO_ID, hashes, simhash

RADIUS = 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text's word shingles, repeats included, as a signed long."""
    return int(simhash(hashes(text, shingle)).view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """`id` (long, never null), `text_hash` and `fp` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "text_hash", "fp"])

    return _read(docs, doc_id, text).mapInArrow(run, "id long, text_hash long, fp long")


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def _masks(bits: int, flips: int) -> list[int]:
    """All masks of at most `flips` set bits, as signed longs."""
    found = [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _with_neighbours(distinct: DataFrame, radius: int) -> DataFrame:
    """Those of the distinct fingerprints `fp` that may have another within `radius` bits; none that has is missing."""
    near = _masks(BITS // 2, radius // 4)
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    tagged = F.concat(_around(low, near), F.transform(_around(high, near), lambda v: v.bitwiseOR(F.lit(1 << 32).cast("long"))))
    met = Window.partitionBy("key")
    emitted = distinct.select("fp", F.explode(tagged).alias("key"))
    emitted = emitted.select("fp", F.count("*").over(met).alias("n"), F.min("fp").over(met).alias("a"), F.max("fp").over(met).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return emitted.where((F.col("n") > 2) | ((F.col("n") == 2) & near)).select("fp").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (`a`, `b`) that join exactly the distinct fingerprints within `radius` bits, directly or over others."""
    ball = _masks(BITS, radius // 2)
    spread = _with_neighbours(distinct, radius).repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    emitted = spread.select("fp", F.explode(_around(F.col("fp"), ball)).alias("variant"))
    star = emitted.select(F.min("fp").over(Window.partitionBy("variant")).alias("a"), F.col("fp").alias("b")).where("a <> b")
    return star.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """`id`, `text_hash`, `fp` and `keeper` of every row, exactly by fingerprints within `radius` bits of 64.

    `keeper` is, of all rows reachable over such links, the smallest struct of id and text hash.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle))
    first = materialize(rows.groupBy("fp").agg(F.min(F.struct("id", "text_hash")).alias("first")))
    return _keepers(rows, first, links(first.select("fp"), radius))


def _keepers(rows: DataFrame, first: DataFrame, edges: DataFrame) -> DataFrame:
    joined = connected_components(edges)
    member = first.join(joined, first["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    # written, so that both sides of the join below are dealt anew and Spark can split a large component
    keeper = materialize(member.groupBy("component").agg(F.min("first").alias("keeper")))
    return rows.join(member.join(keeper, "component").select("fp", "keeper"), "fp")


def _near(first: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (`a`, `b`) of sets that join all whose SimHash, the first word of their `sketch`, is equal or within `radius` bits."""
    held = first.select("fp", F.col("sketch")[0].alias("print"))
    one = materialize(held.groupBy("print").agg(F.min("fp").alias("a")))
    edges = links(one.select(F.col("print").alias("fp")), radius)
    to_a, to_b = (one.select(F.col("print").alias(p), F.col("a").alias(x)) for p, x in (("a", "x"), ("b", "y")))
    across = edges.join(to_a, "a").join(to_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.union(held.join(one, "print").where("a <> fp").select("a", F.col("fp").alias("b")))


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`id`, `text_hash`, `fp` and `keeper` of every row, by a Jaccard similarity of shingles.

    `keeper` is, of all rows reachable over similar ones, the smallest struct of id and text hash. Ball hashing finds
    the sets whose SimHashes are within 4 bits, which is most copies but few of the pairs that are just similar enough:
    at 0.8, SimHashes differ in 15 % of their bits. An exact join of the sets finds the other links. All pairs are
    decided by the sets themselves.
    """
    least, texts = Fraction(str(similarity)), _read(docs, doc_id, text)
    wide = materialize(set_join.sketches(texts, shingle, least))
    rows = materialize(wide.select("id", "text_hash", "fp"))
    picked = [F.first(c).alias(c) for c in ("n", "sketch", "prefix")]
    first = materialize(wide.groupBy("fp").agg(F.min(F.struct("id", "text_hash")).alias("first"), *picked))
    discard(wide)
    edges = set_join.links(first, texts, shingle, least, _near(first))
    return _keepers(rows, first.select("fp", "first"), edges)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay: of every class of similar texts the one with the smallest id."""
    keys = {"_keeper_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "_keeper_hash": F.xxhash64(F.col(text))}
    kept = similar_classes(docs, doc_id, text, shingle, similarity).select("keeper.*").distinct().toDF(*keys)
    stay = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])
    return stay.join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).select("row.*")

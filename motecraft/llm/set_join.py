"""The links of a Jaccard similarity between sets of word shingles, exactly: a prefix-filtered set join.

Every text is the set of its shingles' XXH64. All sets are put into one order, rarest first, so two sets that are similar
enough share a shingle among the first n - ceil(t n) + 1 of each: rows meet there, at every size of the input, and none
that is similar is missed. The order is any that all share; a sample tells which shingles are frequent, which decides
the work and not the result. A pair is looked at only if what follows the shared shingle can still make it similar,
which holds at the first shared one, and if a sketch of 256 bits doesn't rule it out. It is decided by the whole
sets, which are made again only of the texts in such pairs.

What counts is who hangs together, so pairs within a component need no look. First each set is checked against one that
it meets, then against one or two at each shingle; then every pair at a shingle that is still in two components is decided,
at the first shingle that it shares: at a later one it is passed over where one of the few shingles before is shared, too.
Pairs of large sets whose sketches of 256 SimHash bits differ by more than six deviations from what the similarity allows
are ruled out without the sets; of two small sets, those whose shingles, dealt to 192 places, are too often at places that
the other leaves empty, which rules out no pair that is similar.

Defined cases: texts without words are one set, the empty one; fewer words than a shingle make one shingle; letters A to
Z are compared in lower case; null ids count as the largest id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components
from .shingles import BITS, shingle_set, simhash

#: Documents in the sample for the order, at least; shingles known as frequent; members at a shingle that all others are checked against.
SAMPLE, FREQUENT, CENTRES = 5_000, 200_000, 2
#: Words of a sketch; in those of sets smaller than `SMALL`, all but the first hold the places of their shingles.
SKETCH, SMALL = 4, 64
#: How many shingles before a shared one are looked at for an earlier one that the same two sets share.
BEFORE = 4
#: Bits of the filter that tells most texts without a candidate pair: 8 MB, whatever the input.
FILTER = 1 << 26
_BATCH = 1 << 20


def prefix_length(n: int, similarity: Fraction) -> int:
    return n + int(-similarity * n // 1) + 1 if n else 0


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds three times or more, ascending, and how often; it only orders them."""
    n = texts.count()
    if n > SAMPLE:
        texts = texts.where(F.pmod(F.xxhash64("text_hash"), F.lit(1_000_000)) < int(1_000_000 * max(0.01, SAMPLE / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], names=["key"])

    counted = texts.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy()[order]


def sketches(texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """`id`, `text_hash`, `fp` (of the set), its size `n`, its `sketch` and, in the common order, its `prefix`."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, shingle))
    names = ["id", "text_hash", "fp", "n", "sketch", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value

        def rank(h: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(h), np.int64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            return np.where(known[at] == h, often[at], 0)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for i, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingle_set(text, shingle)
                first = h[np.lexsort((h, rank(h)))[: prefix_length(len(h), similarity)]]
                rows.append((i, text_hash, _print(h), len(h), _sketch(h).view(np.int64), first.view(np.int64)))
                held += len(first)
                if held > _BATCH:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return texts.mapInArrow(run, "id long, text_hash long, fp long, n long, sketch array<long>, prefix array<long>")


def _print(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def _sketch(h: np.ndarray) -> np.ndarray:
    """SimHash bits; of a small set one word of them and a bit for each place that its shingles take."""
    if len(h) >= SMALL:
        return simhash([h], SKETCH)
    places = (h % np.uint64(BITS * (SKETCH - 1))).astype(np.int64)
    taken = np.zeros(SKETCH - 1, np.uint64)
    np.bitwise_or.at(taken, places // BITS, np.uint64(1) << (places % BITS).astype(np.uint64))
    return np.concatenate((simhash([h]), taken))


def _filter_bits(places: DataFrame) -> np.ndarray:
    """A filter with the bits at `at` (0 to `FILTER`) set: 64 bits a word, of a fixed size whatever the input."""
    words = places.select(F.floor(F.col("at") / 64).alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits


def emitted(first: DataFrame) -> DataFrame:
    """`key`, `fp`, `n`, `at`: the prefixes' shingles that more than one set has, and a few others.

    Only a number of 32 bits is shuffled for each shingle; a filter then tells those that don't occur twice.
    """
    at = F.pmod(F.xxhash64("key"), F.lit(1 << 32)).alias("at")
    twice = first.select(F.explode("prefix").alias("key")).select(at).groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    shared = first.sparkSession.sparkContext.broadcast(_filter_bits(twice.select((F.col("at") % FILTER).alias("at"))))
    hashed = F.transform("prefix", lambda k: F.pmod(F.xxhash64(k), F.lit(1 << 32)) % FILTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            fp, n = (batch.column(c).to_numpy() for c in (0, 1))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            keys, places = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            own = np.flatnonzero(held[places >> 6] >> (places & 63) & 1)
            row = np.repeat(np.arange(len(fp)), sizes)[own]
            at = own - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[own], fp[row], n[row], at)], names=["key", "fp", "n", "at"])

    return first.select("fp", "n", "prefix", hashed.alias("places")).mapInArrow(run, "key long, fp long, n long, at long")


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """`fp` and `hashes` of the rows of `texts` that `wanted` (`id`, `text_hash`) names, and of a few others.

    The rows are told by a filter of a fixed size, so that no text is shuffled.
    """
    key = F.pmod(F.xxhash64("id", "text_hash"), F.lit(FILTER))
    shared = texts.sparkSession.sparkContext.broadcast(_filter_bits(wanted.select(key.alias("at"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            own = np.flatnonzero(held[at >> 6] >> (at & 63) & 1)
            for text in batch.column(1).take(pa.array(own)).to_pylist():
                h = shingle_set(text, shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_print(h)]), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["fp", "hashes"])

    return texts.select(key.alias("at"), "text").mapInArrow(run, "fp long, hashes array<long>").dropDuplicates(["fp"])


def _may_be_similar(similarity: Fraction) -> Column:
    """Whether a shared shingle and what follows it in both sets can be shared enough."""
    p, q = similarity.numerator, similarity.denominator
    return F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * F.lit(p + q) >= (F.col("n_a") + F.col("n_b")) * F.lit(p)


def bits_apart(similarity: float, bits: int, deviations: float = 6) -> int:
    """How many bits of SimHashes differ at most at a similarity of large sets: the mean and some deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _not_ruled_out(similarity: Fraction) -> Column:
    """Whether the sizes and sketches of two sets allow the similarity."""
    p, q = similarity.numerator, similarity.denominator
    words = [(F.col("sketch_a")[k], F.col("sketch_b")[k]) for k in range(SKETCH)]
    apart = reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in words])
    own_a, own_b = (reduce(add, [F.bit_count(w[i].bitwiseAND(F.bitwise_not(w[1 - i]))) for w in words[1:]]) for i in (0, 1))
    shared = F.least(F.col("n_a") - own_a, F.col("n_b") - own_b)
    small = F.greatest("n_a", "n_b") < SMALL
    near = F.when(small, shared * F.lit(p + q) >= (F.col("n_a") + F.col("n_b")) * F.lit(p)).otherwise((apart <= bits_apart(float(similarity), BITS * SKETCH)) | (F.least("n_a", "n_b") < SMALL))
    return (F.least("n_a", "n_b") * F.lit(q) >= F.greatest("n_a", "n_b") * F.lit(p)) & near


def _similar(pairs: DataFrame, first: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs (`a`, `b`) whose whole sets are similar, each once."""
    p, q = similarity.numerator, similarity.denominator
    a, b = (first.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    pairs = materialize(pairs.distinct().join(a, "a").join(b, "b").where(_not_ruled_out(similarity)).select("a", "b"))
    ends = pairs.select(F.col("a").alias("fp")).distinct().union(pairs.select("b").distinct())
    wanted = first.join(ends, "fp", "left_semi").select("first.*")
    sets = materialize(shingle_sets(texts, wanted, shingle))
    a, b = (sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", (F.size("hashes_a") + F.size("hashes_b")).alias("n"), F.size(F.array_intersect("hashes_a", "hashes_b")).alias("shared"))
    found = materialize(both.where(F.col("shared") * F.lit(q) >= (F.col("n") - F.col("shared")) * F.lit(p)).select("a", "b"))
    discard(sets, pairs)
    return found


def _with_key(rows: DataFrame, *found: Column, where: str) -> DataFrame:
    """`rows` at the keys for which `where` holds of the aggregates `found`, which become columns.

    The aggregates are written, so that both sides of the join are dealt anew and Spark can split a key with many rows.
    """
    return rows.join(materialize(rows.groupBy("key").agg(*found).where(where)), "key")


def _stars(met: DataFrame, may: Column) -> DataFrame:
    """Pairs (`a`, `b`, `at_a`) of each row with the centres of its key, where they are in two components and may be similar.

    The first centre is the set that has the shingle earliest: what is unique to a set comes before, and of a crowd of
    altered copies the original has the least of that, so it is similar to more of them than they are to each other.
    """
    first = [F.col("at"), *[F.xxhash64("fp", F.lit(salt)) for salt in range(1, CENTRES)]]
    own = [F.min(F.struct(by.alias("by"), F.xxhash64("fp").alias("tie"), "fp", "n", "at", "component")).alias(f"to_{k}") for k, by in enumerate(first)]
    apart = materialize(_with_key(met, F.min("component").alias("least"), F.max("component").alias("most"), *own, where="least <> most"))
    pairs = None
    for k in range(CENTRES):
        to = F.col(f"to_{k}")
        star = apart.where(to["component"] != F.col("component"))
        star = star.select(to["fp"].alias("a"), to["n"].alias("n_a"), to["at"].alias("at_a"), F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
        star = star.where(may).select("a", "b", "at_a")
        pairs = star if pairs is None else pairs.union(star)
    return pairs


def _in_components(met: DataFrame, edges: DataFrame) -> DataFrame:
    joined = connected_components(edges)
    return materialize(met.drop("component").join(joined, met["fp"] == joined["node"], "left").select("key", "fp", "n", "at", F.coalesce("component", "fp").alias("component")))


def _with_earlier(rows: DataFrame) -> DataFrame:
    """`rows` with `before`: the keys of the same set's `BEFORE` rows before."""
    return rows.withColumn("before", F.collect_list("key").over(Window.partitionBy("fp").orderBy("at").rowsBetween(-BEFORE, -1)))


def _apart(left: DataFrame, may: Column) -> DataFrame:
    """Pairs (`a`, `b`) of sets of two components that share a key and may be similar.

    A pair whose `before` have a key in common shares that one, too, and is looked at there: at the first key that it
    shares there is none, so every pair is looked at, and at few of the keys that it goes on to share.
    """
    a, b = (left.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "at", "component", "before", "sketch")]) for x in "ab")
    pairs = a.join(b, "key").where(F.col("fp_a") < F.col("fp_b")).where("component_a <> component_b").where(~F.arrays_overlap("before_a", "before_b")).where(may)
    return pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def links(first: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction, candidates: DataFrame) -> DataFrame:
    """Edges (`a`, `b`) that join exactly the sets of `first` at `similarity`, directly or over others.

    `candidates` are pairs to be looked at in any case. Of the centres that a set meets it is first checked against one,
    so that a crowd makes no more pairs than it has members.
    """
    may = _may_be_similar(similarity)
    met = materialize(emitted(first).withColumn("component", F.col("fp")))
    one = _stars(met, may).groupBy("b").agg(F.min(F.struct("at_a", F.xxhash64("a"), "a"))["a"].alias("a")).select("a", "b")
    edges = _similar(candidates.union(one), first, texts, shingle, similarity)
    now = _in_components(met, edges)
    edges = materialize(edges.union(_similar(_stars(now, may).drop("at_a"), first, texts, shingle, similarity)))
    last = _in_components(met, edges)
    discard(met, now)
    left = _with_key(last, F.min("component").alias("least"), F.max("component").alias("most"), where="least <> most")
    left = materialize(_with_earlier(left.drop("least", "most").join(first.select("fp", "sketch"), "fp")))
    discard(last)
    pairs = _apart(left, may & _not_ruled_out(similarity))
    edges = edges.union(_similar(pairs, first, texts, shingle, similarity))
    discard(left)
    return edges

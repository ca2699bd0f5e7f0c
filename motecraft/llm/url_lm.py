"""URL filtering: listed rules, and a character language-model ratio for the rest.

A rule is a host and a path prefix; the longest that fits decides. For URLs without a rule, two variable-order Markov
models over characters, one of accepted and one of rejected URLs, give the difference of their log-likelihoods per
character. Each mixes all context lengths up to `order` by Witten-Bell smoothing and skips contexts it has not seen
twice. The threshold is calibrated on URLs held out from fitting.

All distinct URLs that the rules decide teach: four fifths, by hash, are counted, and the others give the threshold. The
models are tables: a row for each context and character after it, however many there are, is counted by a shuffle, gets
its probability level by level from the context that is one character shorter, and is joined back to the characters of
every URL. `MarkovModel`, `Ratio` and `fit` are the same in memory, for a few URLs; the tests compare the tables to them.
Tables that grow with the URLs are merge-joined: Spark would broadcast them by the size of their files, which are many
times smaller than their rows in the driver's memory.

Defined cases: a null URL and one without `://` have an empty host and path, fit no rule and are judged as the empty
string; a long URL is judged whole; a URL at the threshold is allowed, and of rules of one length, which can't both fit,
none is preferred; without accepted or without rejected URLs to learn from the ratio is 0, which allows; a side without
URLs held out, or with no others, fits and calibrates on the ones it has; of thresholds with equal error the one in the
widest gap counts, then the lowest; repeated rows are judged alike and teach once; an empty table gives an empty result; columns of the input other than id and URL are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Fixed rules: rule text and verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
START, END, UNSEEN = "\x02", "\x03", 1 / 1024
#: One distinct URL in so many is held out from fitting. Log ratios are summed as whole numbers of this part, so that no order of rows matters.
FOLDS, UNIT = 5, 1e-9
_BATCH = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path up to the query or fragment; both empty where there is no `://`."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    known = at > 0
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def longest_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        found = F.when(fits, rule).otherwise(found)
    return found


@dataclass
class MarkovModel:
    """Counts of characters after contexts of up to `order` characters."""

    order: int = 5
    after: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: list[str], order: int = 5) -> MarkovModel:
        seen: dict[str, Counter] = defaultdict(Counter)
        for text in texts:
            chars = START + text + END
            for i in range(1, len(chars)):
                for k in range(min(order, i) + 1):
                    seen[chars[i - k : i]][chars[i]] += 1
        return cls(order, {c: dict(n) for c, n in seen.items() if not c or sum(n.values()) > 1})

    def log_likelihood(self, text: str) -> float:
        chars, total = START + text + END, 0.0
        for i in range(1, len(chars)):
            p = UNSEEN
            for k in range(min(self.order, i) + 1):
                counts = self.after.get(chars[i - k : i])
                if counts is None:
                    break
                p = (counts.get(chars[i], 0) + len(counts) * p) / (sum(counts.values()) + len(counts))
            total += math.log(p)
        return total


@dataclass
class Ratio:
    """The two models, and the threshold and spread that calibrate their difference."""

    accepted: MarkovModel | None = None
    rejected: MarkovModel | None = None
    threshold: float = 0.0
    spread: float = 1.0

    def raw(self, text: str) -> float:
        if not self.accepted or not self.rejected:
            return 0.0
        return (self.accepted.log_likelihood(text) - self.rejected.log_likelihood(text)) / (len(text) + 1)

    def __call__(self, text: str) -> float:
        """Above 0: rather accepted."""
        return (self.raw(text) - self.threshold) / self.spread


def fit(accepted: list[str], rejected: list[str], order: int = 5) -> Ratio:
    """Models on four fifths of each side; the threshold with the least balanced error on the rest."""
    if not accepted or not rejected:
        return Ratio()
    sides = [sorted(x) for x in (accepted, rejected)]
    held = [s[::5] for s in sides]
    fitted = [[u for i, u in enumerate(s) if i % 5] or s for s in sides]
    ratio = Ratio(*(MarkovModel.fit(s, order) for s in fitted))
    good, bad = (np.sort([ratio.raw(u) for u in h]) for h in held)
    every = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(((every[:-1] + every[1:]) / 2, [every[0] - 1e-9]))
    error = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    ratio.threshold = float(np.median(cuts[error == error.min()]))
    ratio.spread = float(np.std(np.concatenate((good, bad)))) or 1.0
    return ratio


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """`of` (a long) of each row, and `gram`: every character of `text`, and its end, with up to `order` characters before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars = START + text + END
                for k in range(1, len(chars), _BATCH):
                    found = [chars[max(0, i - order) : i + 1] for i in range(k, min(k + _BATCH, len(chars)))]
                    yield pa.RecordBatch.from_arrays([pa.array([of] * len(found), pa.int64()), pa.array(found, pa.string())], names=["of", "gram"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= _BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return urls.select(F.col("of").cast("long"), "text").mapInArrow(packed, "of long, gram string")


def counts(urls: DataFrame, order: int = 5) -> DataFrame:
    """`gram` and `n_0`, `n_1`: how often its last character follows the others in `text` where `of` is 0 and where it is 1.

    All URLs' grams have a row, with all shorter contexts, whether they are counted or not (`of` 2).
    """
    sums = [F.sum(f"n_{side}").alias(f"n_{side}") for side in (0, 1)]
    whole = _grams(urls, order).groupBy("gram").agg(*[F.count_if(F.col("of") == side).alias(f"n_{side}") for side in (0, 1)])
    size = F.length("gram")
    ends = F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(F.col("gram"), size - k + 1, k))
    return whole.select(F.explode(ends).alias("gram"), "n_0", "n_1").groupBy("gram").agg(*sums)


def log_ratios(urls: DataFrame, order: int = 5) -> DataFrame:
    """`gram` and `log_ratio` (in `UNIT`) of the character at the end, given the others, for the grams of all `urls`."""
    context = Window.partitionBy("context")
    found = counts(urls, order).withColumn("context", F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1))
    for side in (0, 1):
        n = F.col(f"n_{side}")
        found = found.withColumns({f"total_{side}": F.sum(n).over(context), f"kinds_{side}": F.count_if(n > 0).over(context)})
    found = materialize(found.drop("context").withColumn("size", F.length("gram")))
    lower, levels = None, []
    for size in range(1, order + 2):
        level = found.where(F.col("size") == size)
        if lower is None:
            level = level.withColumns({f"p_{side}": F.lit(UNSEEN) for side in (0, 1)})
        else:
            level = level.withColumn("rest", F.substring(F.col("gram"), F.lit(2), F.lit(size))).join(lower.withColumnRenamed("gram", "rest").hint("merge"), "rest")
        for side in (0, 1):
            n, total, kinds, p = (F.col(f"{c}_{side}") for c in ("n", "total", "kinds", "p"))
            known = total > (0 if size == 1 else 1)
            level = level.withColumn(f"p_{side}", F.when(known, (n + kinds * p) / (total + kinds)).otherwise(p))
        lower = materialize(level.select("gram", "p_0", "p_1"))
        levels.append(lower)
    ends = levels[-1]
    for level in levels[:-1]:
        ends = ends.union(level.where(F.col("gram").startswith(START)))
    made = materialize(ends.select("gram", F.round((F.ln("p_0") - F.ln("p_1")) / UNIT).cast("long").alias("log_ratio")))
    discard(found, *levels)
    return made


def raw_ratios(urls: DataFrame, order: int = 5) -> DataFrame:
    """`urls` with `raw`: the difference of the two log-likelihoods, per character, by the URLs with `of` 0 and 1.

    `urls` has `id` (distinct), `text` and `of`.
    """
    ratios = log_ratios(urls, order)
    summed = _grams(urls.select(F.col("id").alias("of"), "text"), order).join(ratios.hint("merge"), "gram").groupBy(F.col("of").alias("id")).agg(F.sum("log_ratio").alias("log_ratio"))
    return urls.join(summed.hint("merge"), "id").withColumn("raw", F.col("log_ratio") * UNIT / (F.length("text") + 1)).drop("log_ratio")


def threshold(held: DataFrame) -> float:
    """The cut through `raw` with the least balanced error between `good` rows, at or above it, and the others, below.

    Scores are dealt by ranges and counted within each, after the counts of the ranges before.
    """
    good, bad = F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    ranged = materialize(held.groupBy("raw").agg(good, bad).repartitionByRange("raw").withColumn("part", F.spark_partition_id()))
    parts, before = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("raw").alias("first"))
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"earlier_{c}") for c in ("good", "bad")]
    starts = ranges.select("part", *earlier, F.lead("first").over(parts).alias("after"))
    own = Window.partitionBy("part").orderBy("raw")
    total = ranges.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("first").alias("first")).first()
    after = F.coalesce(F.lead("raw").over(own), F.col("after"))
    below = [F.col(f"earlier_{c}") + F.sum(c).over(own) for c in ("good", "bad")]
    cuts = ranged.join(F.broadcast(starts), "part").select("raw", after.alias("after"), (below[0] * total["bad"] - below[1] * total["good"]).alias("error"))
    cuts = cuts.where("after is not null").select("error", (F.col("raw") - F.col("after")).alias("gap"), ((F.col("raw") + F.col("after")) / 2).alias("cut"))
    best = cuts.agg(F.min(F.struct("error", "gap", "cut")).alias("best")).first()["best"]
    discard(ranged)
    return best["cut"] if best and best["error"] < 0 else total["first"] - 1e-9


def ratios(urls: DataFrame, order: int = 5) -> DataFrame:
    """`text` and `ratio` (the calibrated difference) of distinct `urls`, from all whose `verdict` is allow or block."""
    side = F.when(F.col("verdict") == "allow", 0).when(F.col("verdict") == "block", 1).otherwise(2)
    out = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    numbered = materialize(urls.select(F.monotonically_increasing_id().alias("id"), "text", side.alias("side"), out.alias("out")))
    n = {(r["side"], r["out"]): r["count"] for r in numbered.groupBy("side", "out").count().collect()}
    if not all(any((k, o) in n for o in (True, False)) for k in (0, 1)):
        return numbered.select("text", F.lit(0.0).alias("ratio"))
    both = [k for k in (0, 1) if len([o for o in (True, False) if (k, o) in n]) == 1]
    twice = F.col("side").isin(both) if both else F.lit(False)
    fitted = F.when(~F.col("out") | twice, F.col("side")).otherwise(2)
    scored = materialize(raw_ratios(numbered.withColumn("of", fitted), order))
    held = scored.where((F.col("side") < 2) & (F.col("out") | twice)).select("raw", (F.col("side") == 0).alias("good"))
    spread = held.agg(F.round(F.stddev_pop("raw"), 12)).first()[0] or 1.0
    return scored.select("text", ((F.col("raw") - threshold(held)) / spread).alias("ratio"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, page_id: str = "page_id", url: str = "url", order: int = 5) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` and `ratio` (the calibrated difference) of every row."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    listed = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    parts = parts.withColumn("verdict", F.when(F.col("rule").isNotNull(), listed[F.col("rule")]))
    scored = parts.join(ratios(parts.select("text", "verdict").distinct(), order).hint("merge"), "text")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("ratio") >= 0, "allow").otherwise("block")).alias("verdict"), "ratio")

"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

All text that is trusted is counted: four-grams of characters, as they are, so that the tables grow with the text. Lower
orders count in how many contexts an n-gram stands. Counts stay in tables sharded by n-gram; discounts, context totals
and interpolation come from joins of an n-gram's row with its context's and its shorter n-gram's.

Perplexity comes from joins, too. Documents are stored in batches of some 32 MB. A batch asks for each n-gram in it once,
with its counts over the batch's trusted documents, so that what is shuffled are a batch's distinct n-grams and not the
text; the answers come back to the batch, whose documents add them up. The stored batches are bucketed, so that texts are
never shuffled.

A document passes if its perplexity is at most a high quantile of the trusted documents of its language, or of all
trusted ones where its language has none. As the model knows the text it counted too well to set thresholds on it, each
fold of the trusted documents is scored for that with the counts of the other folds. A quantile of few documents is
little more than their largest, so it is shrunk towards the language's mean log-perplexity and the distance from the mean
that all languages share, widened by what the mean of few documents may be off; and it is never below the own quantile.

Defined cases: a null or empty text has no perplexity and doesn't pass; without any trusted text to count, or too
little to set a threshold, nothing is known and every document with text passes; a text of any length is read in pieces;
equal texts and repeated rows are judged alike, ties at the threshold pass; an empty table gives an empty result; columns
of the inputs other than id, text, lang and quality are not looked at, whatever their names. The characters U+0000 and
U+0002 count as one and the same in all texts, the start of a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import discard, fold_remainder, materialize, scratch_folder

ORDER = 4
QUANTILE = 0.995
#: Folds of the trusted documents; each is scored with the counts of the others.
FOLDS = 3
#: Characters in a batch of documents, and in a piece of a text.
BATCH, STEP = 1 << 25, 1 << 20
START = 2


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of texts, in pieces: characters, where in them n-grams begin, and which text each is of.

    Each text is preceded by starts, so that it has as many n-grams as characters.
    """

    def joined(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(p) - ORDER + 1 for _, p in parts])
        at = np.arange(n.sum()) + np.repeat(np.arange(len(parts)) * (ORDER - 1), n)
        return np.concatenate([p for _, p in parts]), at, np.repeat([i for i, _ in parts], n)

    held, size = [], 0
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        padded = np.concatenate((np.full(ORDER - 1, START, np.uint32), np.where(points == 0, np.uint32(START), points)))
        for k in range(0, len(points), STEP):
            held.append((i, padded[k : k + STEP + ORDER - 1]))
            size += len(held[-1][1])
            if size >= STEP:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def _keys(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams at `at`, which tell them apart within a batch."""
    h = np.zeros(len(points), np.uint64)
    for k in range(ORDER):
        h[: len(points) - k] = (h[: len(points) - k] ^ points[k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h[at]


def _strings(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(points[at[:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()


def seen(texts: list[str | None], folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, and how often each stands in the texts of each fold; a fold of -1 is none."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, first, back = np.unique(np.concatenate([k for k, _, _ in parts]), return_index=True, return_inverse=True)
        counts = np.concatenate([n for _, _, n in parts])
        total = np.stack([np.bincount(back, counts[:, f], len(keys)) for f in range(FOLDS)], axis=1)
        return keys, np.concatenate([g for _, g, _ in parts])[first], total.astype(np.int64)

    for points, at, owner in windows(texts):
        keys, first, back = np.unique(_keys(points, at), return_index=True, return_inverse=True)
        own = folds[owner]
        counts = np.stack([np.bincount(back[own == f], minlength=len(keys)) for f in range(FOLDS)], axis=1)
        parts.append((keys, _strings(points, at[first]), counts))
        if len(parts) > 16:
            parts = [merged()]
    if not parts:
        return np.empty(0, f"<U{ORDER}"), np.zeros((0, FOLDS), np.int64)
    return merged()[1:]


def log_sums(texts: list[str | None], grams: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sums of `logs` (a column per model) over its n-grams, and their number."""
    total, n = np.zeros((len(texts), logs.shape[1])), np.zeros(len(texts), np.int64)
    if not len(grams):
        return total, n
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _keys(points, np.arange(len(grams)) * ORDER)
    order = np.argsort(known)
    known, logs = known[order], logs[order]
    for points, at, owner in windows(texts):
        where = np.searchsorted(known, _keys(points, at))
        for m in range(logs.shape[1]):
            total[:, m] += np.bincount(owner, logs[where, m], len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return total, n


def _stored(docs: DataFrame) -> DataFrame:
    """`docs` (with a `body`) with the number of their batch, in a table bucketed by it."""
    kind = StructType([*docs.schema, StructField("batch", LongType())])
    body = docs.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = [len(t or "") for t in batch.column(body).to_pylist()]
            numbers = []
            for size in sizes:
                if held and held + size > BATCH:
                    at, held = at + 1, 0
                held += size
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "batch"])

    spark, name = docs.sparkSession, f"batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch_folder(spark)}/{name}"
    docs.mapInArrow(run, kind).write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    stored = spark.table(name)
    stored.written_to, stored.named = path, name
    return stored


#: Counts of each fold; a model leaves one fold out, and the last model leaves out none.
_COUNTS = [f"n{f}" for f in range(FOLDS)]
MODELS = range(FOLDS + 1)


def _each(make) -> list[Column]:
    """A column for each model."""
    return [make(m) for m in MODELS]


def _discounts(level: DataFrame) -> list[list[float]]:
    """Of each model, the modified discounts for counts of 1, 2 and 3 or more."""
    row = level.agg(*[F.count_if(F.col(f"c{m}") == k).alias(f"c{m}_{k}") for m in MODELS for k in (1, 2, 3, 4)]).first()
    found = []
    for m in MODELS:
        n = [max(1, row[f"c{m}_{k}"]) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        found.append([min(0.95 * k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)])
    return found


def log_probabilities(counted: DataFrame) -> DataFrame:
    """`gram` and, of each model m, the log-probability `p{m}` of its last character after the others.

    `counted` has all n-grams that are asked for, with the models' counts `c{m}`, which may be zero.
    """
    levels = [counted]
    for _ in range(ORDER - 1):
        shorter = levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
        levels.append(materialize(shorter.agg(*_each(lambda m: F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}")))))
    p = None
    for order, level in enumerate(reversed(levels), 1):
        d = _discounts(level)
        cut = _each(lambda m, d=d: F.when(F.col(f"c{m}") == 0, 0.0).when(F.col(f"c{m}") == 1, d[m][0]).when(F.col(f"c{m}") == 2, d[m][1]).otherwise(d[m][2]))
        level = level.select("gram", F.substring("gram", 1, order - 1).alias("context"), *_each(lambda m: F.col(f"c{m}")), *_each(lambda m, cut=cut: cut[m].alias(f"d{m}")))
        contexts = level.groupBy("context").agg(*_each(lambda m: F.sum(f"c{m}").alias(f"t{m}")), *_each(lambda m: F.sum(f"d{m}").alias(f"w{m}")))
        now = level.join(contexts, "context")
        if p is None:
            # all that is known of a character never seen is that it is one more than those seen
            size = level.agg(*_each(lambda m: F.count_if(F.col(f"c{m}") > 0).alias(f"c{m}"))).first()
            lower = _each(lambda m, size=size: F.lit(1.0 / (size[m] + 1)))
        else:
            now = now.join(p.withColumnRenamed("gram", "shorter"), F.expr("substring(gram, 2)") == F.col("shorter"))
            lower = _each(lambda m: F.col(f"p{m}"))
        p = now.select("gram", *_each(lambda m, lower=lower: F.when(F.col(f"t{m}") > 0, (F.col(f"c{m}") - F.col(f"d{m}") + F.col(f"w{m}") * lower[m]) / F.col(f"t{m}")).otherwise(lower[m]).alias(f"p{m}")))
    # a probability and its logarithm need no more than a float
    logs = materialize(p.select("gram", *_each(lambda m: F.ln(f"p{m}").cast("float").alias(f"p{m}"))))
    discard(*levels[1:])
    return logs


def count(stored: DataFrame, trusted: DataFrame) -> DataFrame:
    """`batch`, `gram` and its counts in each fold: a row for each n-gram of a batch of `stored`.

    `trusted` has `batch`, `trusted_id` and `fold`.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        folds = dict(zip(right["trusted_id"].to_pylist(), right["fold"].to_pylist(), strict=True))
        own = np.array([folds.get(i, -1) for i in left["id"].to_pylist()], np.int64)
        grams, n = seen(left["body"].to_pylist(), own)
        batch = left["batch"].to_pylist()[:1] * len(grams)
        return pa.table([pa.array(batch, pa.int64()), pa.array(grams.tolist(), pa.string()), *(pa.array(n[:, f]) for f in range(FOLDS))], names=["batch", "gram", *_COUNTS])

    texts = stored.select("batch", "id", "body")
    return texts.groupBy("batch").cogroup(trusted.groupBy("batch")).applyInArrow(run, f"batch long, gram string, {', '.join(f'{n} long' for n in _COUNTS)}")


def score(stored: DataFrame, logs: DataFrame, trusted: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `stored`, `perplexity` and, of trusted documents, `apart`: the perplexity under the other folds' model.

    `logs` has `batch`, `gram` and the columns of `log_probabilities`; `trusted` as in `count`.
    """
    names = [f"p{m}" for m in MODELS]
    answers = logs.withColumns({"trusted_id": F.lit(None).cast(trusted.schema["trusted_id"].dataType), "fold": F.lit(None).cast("int")})
    known = trusted.select("batch", F.lit(None).cast("string").alias("gram"), *[F.lit(None).cast("float").alias(n) for n in names], "trusted_id", "fold")
    kind = StructType([*stored.select(*columns).schema, StructField("perplexity", DoubleType()), StructField("apart", DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_gram = pa.compute.is_valid(right["gram"])
        found, others = right.filter(is_gram), right.filter(pa.compute.invert(is_gram))
        folds = dict(zip(others["trusted_id"].to_pylist(), others["fold"].to_pylist(), strict=True))
        logs = np.stack([found[n].to_numpy() for n in names], axis=1)
        total, n = log_sums(left["body"].to_pylist(), found["gram"].to_pylist(), logs)
        fold = [folds.get(i) for i in left["id"].to_pylist()]
        value = lambda i, m: float(np.exp(-total[i, m] / n[i])) if m is not None and n[i] else None
        found = [[value(i, FOLDS) for i in range(len(n))], [value(i, f) for i, f in enumerate(fold)]]
        return pa.table([*(left[c] for c in columns), *(pa.array(x, pa.float64()) for x in found)], names=[*columns, "perplexity", "apart"])

    texts = stored.select("batch", "id", "rest", "language", "body")
    return texts.groupBy("batch").cogroup(answers.unionByName(known).groupBy("batch")).applyInArrow(run, kind)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns `keep`), `perplexity`, `threshold` and `kept` of every row.

    Trusted are the documents whose `quality` in `labels` is 1.
    """
    wanted = keep or docs.columns
    others = [c for c in wanted if c != text] or [doc_id]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(doc_id).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("language"), F.col(text).alias("body"))
    row = F.struct(*[(F.col("body") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in wanted]).alias("row")
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    stored = _stored(base)
    trusted = stored.select("batch", "id").join(trusted, F.col("id") == F.col("trusted_id")).select("batch", "trusted_id").distinct()
    trusted = materialize(trusted.withColumn("fold", fold_remainder(F.col("trusted_id"), FOLDS).cast("int")))
    asked = materialize(count(stored, trusted))
    sums = [F.sum(n).alias(n) for n in _COUNTS]
    everything = sum((F.col(n) for n in _COUNTS[1:]), F.col(_COUNTS[0]))
    counted = asked.groupBy("gram").agg(*sums).select("gram", *_each(lambda m: (everything - F.col(_COUNTS[m]) if m < FOLDS else everything).alias(f"c{m}")))
    counted = materialize(counted)
    sizes = counted.agg(*_each(lambda m: F.sum(f"c{m}"))).first()
    if not sizes[FOLDS]:
        unknown = F.lit(None).cast("double")
        return base.select(row, unknown.alias("perplexity"), unknown.alias("threshold"), (F.length("body") > 0).alias("kept"))
    logs = log_probabilities(counted)
    able = trusted.where(F.col("fold").isin([f for f in range(FOLDS) if sizes[f]]))
    columns = ["rest", "language", *(["body"] if text in wanted else [])]
    scored = materialize(score(stored, asked.select("batch", "gram").join(logs, "gram"), able, columns))
    discard(stored, trusted, asked, counted, logs)
    docs.sparkSession.sql(f"DROP TABLE {stored.named}")
    sure = scored.where("apart is not null").select("language", F.col("apart").alias("perplexity"))
    if sure.isEmpty():
        scored = scored.withColumn("threshold", F.lit(float("inf")))
    else:
        overall = sure.agg(_quantile(F.col("perplexity"), quantile)).first()[0]
        scored = scored.join(materialize(thresholds(sure, quantile)), "language", "left")
        scored = scored.withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double"), F.lit(float("inf"))))
    return scored.select(row, "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def _quantile(value: Column, quantile: float) -> Column:
    return F.percentile_approx(value, F.lit(quantile), F.lit(10000))


def thresholds(sure: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """`language`, `threshold` from the `perplexity` of trusted documents."""
    logs = sure.select("language", F.log("perplexity").alias("x"))
    own = materialize(logs.groupBy("language").agg(F.count("*").alias("k"), F.avg("x").alias("mean"), _quantile(F.col("x"), quantile).alias("own")))
    # a mean of k documents hides 1 / k of their variance
    apart = logs.join(F.broadcast(own.where("k > 1")), "language").select(((F.col("x") - F.col("mean")) * F.sqrt(F.col("k") / (F.col("k") - 1))).alias("r"))
    found = apart.agg(_quantile(F.col("r"), quantile).alias("cut"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("spread")).first()
    if found["cut"] is None:
        return own.select("language", F.lit(float("inf")).alias("threshold"))
    shared = max(found["cut"], NormalDist().inv_cdf(quantile) * found["spread"])
    weight = F.col("k") * (1 - quantile) / (F.col("k") * (1 - quantile) + 1)
    wide = F.col("mean") + shared * F.sqrt(1 + 1 / F.col("k"))
    return own.select("language", F.exp(F.greatest("own", weight * F.col("own") + (1 - weight) * wide)).alias("threshold"))

"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; everything else is unlabelled and may be toxic too. A linear classifier in
numpy is trained on the risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)): where the second
term falls below zero, its gradient is reversed, so that the classifier can't gain by fitting the unlabelled rows.

Features are the presence of words, and of words' first four letters. Those are used that enough positives hold, and
hold more often than unlabelled rows do, counted over all of these; the gradient steps use bounded samples (`positives`
and `unlabelled`), scoring every whole text.

Defined cases: a null or empty text has no feature and takes the score of the bias; without positives every score is 0;
duplicate label rows count once; long texts are scored whole; repeated rows and equal texts are scored alike; an empty table gives an empty result; columns of the
inputs other than id, text and toxic are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_given

_WORDS = re.compile(r"[^\W\d_]+")
PREFIX = 4


@dataclass(frozen=True)
class Settings:
    """Bounds of the samples, what makes a feature, and how the risk is minimised.

    `positives` bounds the labelled rows that the gradient steps use, `unlabelled` the others; the words of those
    positives are the candidates for features.
    """

    positives: int = 4000
    unlabelled: int = 12000
    least_positives: int = 4
    lift: float = 0.35
    rounds: int = 300
    rate: float = 0.05
    ridge: float = 2e-4
    beta: float = 0.0


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and their first four letters followed by `*`."""
    words = set(_WORDS.findall(text.lower())) if text else set()
    return words | {f"{w[:PREFIX]}*" for w in words if len(w) > PREFIX}


def minimise(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk under the logistic loss; rows are lists of feature numbers."""
    rows = positive + unlabelled
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate([*rows, np.empty(0, int)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    is_p = np.arange(len(rows)) < len(positive)
    w, b, m, v = np.zeros(n), float(np.log(prior / (1 - prior))), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, s.rounds + 1):
        z = np.bincount(owner, w[flat], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        slack = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        g_pos = np.where(is_p, prior * (p - 1) / max(1, is_p.sum()), 0.0)
        g_neg = np.where(is_p, -prior * p / max(1, is_p.sum()), p / max(1, (~is_p).sum()))
        g = g_pos + g_neg if slack >= -s.beta else -g_neg
        grad = np.append(np.bincount(flat, g[owner], n) + s.ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _featurised(docs: DataFrame, at: dict[str, int]) -> list[np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [sorted(at[w] for w in at.keys() & tokens(t)) for t in batch["text"]]})

    return [np.asarray(r["x"], int) for r in docs.mapInPandas(run, "x array<int>").toLocalIterator()]


def _frequencies(docs: DataFrame, at: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, and the number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total[[at[w] for w in at.keys() & tokens(text)]] += 1
            total[-1] += len(batch)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"x": held, "n": total[held]})

    found = docs.select("text").mapInPandas(run, "x int, n long").groupBy("x").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(at) + 1, np.int64)
    total[found["x"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total[:-1], int(total[-1])


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most `bound` rows, and about nine tenths of it where there are more, chosen by a hash of the id."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(900_000 * bound / n)).limit(bound)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict | None:
    """Words' weights (`weights`), `bias` and `prior`, from `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    marked = labels.select("doc_id", "toxic").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = marked.where("toxic = 1").select("doc_id")
    rate = marked.agg(F.avg("toxic").alias("p")).first()["p"]
    if not rate:
        return None
    prior = min(0.95, max(1e-4, rate))
    chosen = docs.join(_sample(toxic, settings.positives), "doc_id", "left_semi")
    unlabelled = docs.join(_sample(docs.select("doc_id"), settings.unlabelled), "doc_id", "left_semi")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": [w for t in batch["text"] for w in tokens(t)]})

    common = chosen.mapInPandas(words, "word string").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least_positives)
    at = {r["word"]: i for i, r in enumerate(common.orderBy(F.desc("n"), "word").collect())}
    positive, rest = _featurised(chosen, at), _featurised(unlabelled, at)
    if not at or not positive or not rest:
        return None
    used = telling(positive, *_frequencies(docs, at), prior, settings)
    new = np.cumsum(used) - 1
    positive, rest = ([new[r[used[r]]] for r in rows] for rows in (positive, rest))
    w, bias = minimise(positive, rest, int(used.sum()), prior, settings)
    return {"weights": {k: float(w[new[i]]) for k, i in at.items() if used[i]}, "bias": bias, "prior": prior}


def telling(positive: list[np.ndarray], u: np.ndarray, unlabelled: int, prior: float, s: Settings) -> np.ndarray:
    """Features that positives hold more often than all `unlabelled` rows do, `u` of which hold each, beyond chance.

    A feature that only positives have is 1 / prior times as frequent among them; `lift` is the share of that way from
    1 that a feature must reach.
    """
    p = np.bincount(np.concatenate([*positive, np.empty(0, int)]).astype(np.int64), minlength=len(u))
    expected = len(positive) * (u + 1) / (unlabelled + 2)
    return (p >= (1 + s.lift * (1 / prior - 1)) * expected) & (p - expected >= 4 * np.sqrt(expected))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """`doc_id` and `score` (0 to 1) of every row."""
    weights, bias = (model["weights"], model["bias"]) if model else ({}, None)

    def one(text: str | None) -> float:
        if bias is None:
            return 0.0
        z = bias + sum(weights[w] for w in sorted(weights.keys() & tokens(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [one(t) for t in batch["text"]]})

    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, score double")
    return as_given(made, "doc_id", docs)

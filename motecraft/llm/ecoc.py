"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over hashed character trigrams tells the
languages with a one from those with a zero: its weights are log ratios of trigram shares, from counts over all training
rows. A text's margins are compared with each codeword under a logistic loss, weighted by how often the bit is right: the log
odds of its error on a fifth of the training rows, with weights from the others. The codeword with the least loss wins,
and a narrow win is flagged as ambiguous.

Defined cases: a null text and one without a letter give `und` with score 0; texts shorter than a trigram are padded
with spaces, which every text has at both ends; long texts are counted in pieces; of codewords with the same loss the
first language in order wins; without any training row all predictions are `und`; repeated rows are
predicted alike; an empty table gives an empty result; columns of the input other than id, text and language are not
looked at, the language only where a model is trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_given

UNDETERMINED = "und"
#: Trigram buckets, a power of two.
BUCKETS = 1 << 13
#: Up to this many languages all distinct bits are used, beyond it random ones.
EXHAUSTIVE = 6
AMBIGUOUS = 0.6
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: One in so many training rows tests the bits.
TESTED = 5
_STEP = 1 << 20


def letters(text: str | None) -> str:
    """Lower-case words of letters, with one space between them and at both ends; empty if there is no letter."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {found} " if any(map(str.isalpha, found)) else ""


def trigram_counts(clean: str) -> np.ndarray:
    """Counts of hashed byte trigrams of `letters(text)`."""
    b = np.frombuffer(clean.encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(b) - 2, _STEP):
        part = b[k : k + _STEP + 2].astype(np.uint32)
        code = (part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
        total += np.bincount(code, minlength=BUCKETS)
    return total


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1, one row a language, no bit constant and no two bits equal or opposite."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [[1 if i == 0 or i in chosen else -1 for i in range(n)] for k in range(n - 1) for chosen in combinations(range(1, n), k)]
        return np.array(columns, float).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, 15 * int(np.ceil(np.log2(n)))))
        m = m[:, np.abs(m.sum(0)) < n]
        least = min(int((a != b).sum()) for a, b in combinations(m, 2)) if n <= 64 else 0
        if best is None or least > best[0]:
            best = least, m
    return best[1]


@dataclass
class Model:
    """Languages, their codewords, a weight column for each bit, and each bit's scale and weight in decoding."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[str, float]:
        """The language with the least weighted loss, and its share against the others."""
        margins = (counts @ self.weights) / max(1, counts.sum()) * self.scale
        loss = (np.logaddexp(0.0, -self.code * margins) * self.trust).sum(axis=1)
        odds = np.exp(loss.min() - loss)
        return self.languages[int(loss.argmin())], float(odds.max() / odds.sum())


def count_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang`, `tested` (whether of the rows that test the bits), `bucket`, `n` over all rows of `docs` with a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            for *key, value in zip(batch["lang"], batch["tested"], batch["text"], strict=True):
                counts, key = trigram_counts(letters(value)), tuple(key)
                held[key] = held[key] + counts if key in held else counts
        for (name, tested), counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": name, "tested": tested, "bucket": at, "n": counts[at]})

    return _read(docs, text, lang).mapInPandas(run, "lang string, tested boolean, bucket int, n long").groupBy("lang", "tested", "bucket").agg(F.sum("n").alias("n"))


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    tested = F.pmod(F.xxhash64(F.col(text)), F.lit(TESTED)) == 0
    return docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), tested.alias("tested")).where("lang is not null and text is not null")


def _classifiers(counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each bit's classifier, and the factors that bring the languages' margins to one scale."""
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    ones, zeros = (np.array([share[code[:, b] == side].mean(axis=0) if (code[:, b] == side).any() else np.full(BUCKETS, 1 / BUCKETS) for b in range(code.shape[1])]).T for side in (1, -1))
    weights = np.log(ones) - np.log(zeros)
    return weights, 4.0 / (np.abs(share @ weights).min(axis=0) + 1e-9)


def bit_errors(docs: DataFrame, languages: list[str], code: np.ndarray, weights: np.ndarray, text: str = "text", lang: str = "lang") -> np.ndarray:
    """The share of the rows that test the bits on which each bit's classifier errs; one error is added, and one success."""
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrong, n = np.zeros(code.shape[1], np.int64), 0
        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"], strict=True):
                if clean := letters(value):
                    wrong += np.sign(trigram_counts(clean) @ weights) != code[at[name]]
                    n += 1
        yield pd.DataFrame({"bit": np.arange(len(wrong)), "wrong": wrong, "n": n})

    found = _read(docs, text, lang).where("tested").select("lang", "text").mapInPandas(run, "bit int, wrong long, n long").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).toPandas()
    wrong, n = np.zeros(code.shape[1]), np.zeros(code.shape[1])
    wrong[found["bit"]], n[found["bit"]] = found["wrong"], found["n"]
    return (wrong + 1) / (n + 2)


def bit_trust(errors: np.ndarray) -> np.ndarray:
    """Weights in decoding: the log odds of being right, 2 on average; a bit that tells nothing has next to none."""
    odds = np.maximum(np.log((1 - errors) / errors), 0.01)
    return 2 * odds / odds.mean()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from all rows of `docs`; what comes to the driver is one count per language and bucket."""
    counted = count_languages(docs, text, lang).toPandas()
    languages = sorted(counted["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((2, len(languages), BUCKETS))
    counts[counted["tested"].astype(int), counted["lang"].map({k: i for i, k in enumerate(languages)}), counted["bucket"]] = counted["n"]
    code = code_matrix(len(languages))
    trust = bit_trust(bit_errors(docs, languages, code, _classifiers(counts[0], code)[0], text, lang))
    return Model(languages, code, *_classifiers(counts.sum(axis=0), code), trust)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `lang_pred`, `score` and `ambiguous` of every row."""

    def one(value: str | None) -> tuple[str, float]:
        clean = letters(value)
        return model.decode(trigram_counts(clean)) if clean and model else (UNDETERMINED, 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(t) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})
            yield out.assign(ambiguous=out["score"] < AMBIGUOUS)

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = read.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, lang_pred string, score double, ambiguous boolean")
    return as_given(made, "doc_id", read)

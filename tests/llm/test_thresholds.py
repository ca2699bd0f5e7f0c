"""Thresholds of languages with few trusted documents."""

import math
import random

import pytest

from motecraft.llm import kneser_ney

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, langs):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)


def test_few_trusted_documents_keep_their_languages_clean_ones(spark):
    rng = random.Random(31)
    texts = [prose(rng, 60) for _ in range(300)] + [prose(rng, 60, "lmnopqruv") for _ in range(130)]
    docs = documents(spark, texts, ["en"] * 300 + ["fr"] * 130)
    labels = spark.createDataFrame([(i, 1) for i in [*range(0, 300, 2), *range(300, 310)]], "doc_id long, quality int")
    rows = {r["row"]["doc_id"]: r for r in kneser_ney.judge(docs, labels).collect()}
    assert sum(not rows[i]["kept"] for i in range(310, 430)) <= 3
    assert sum(not rows[i]["kept"] for i in range(300)) <= 6


def test_thresholds_shrink_with_the_number_of_documents(spark):
    rng = random.Random(32)
    found = [("a", math.exp(rng.gauss(2, 0.1))) for _ in range(4000)] + [("b", math.exp(rng.gauss(3, 0.1))) for _ in range(4)] + [("c", 9.0)]
    got = {r["language"]: math.log(r["threshold"]) for r in kneser_ney.thresholds(spark.createDataFrame(found, "language string, perplexity double")).collect()}
    assert got["a"] == pytest.approx(2.26, abs=0.03)
    mean = sum(math.log(p) for x, p in found if x == "b") / 4
    assert got["b"] == pytest.approx(mean + 0.26 * math.sqrt(1.25), abs=0.05)
    assert got["c"] == pytest.approx(math.log(9) + 0.26 * math.sqrt(2), abs=0.05)

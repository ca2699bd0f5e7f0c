"""Frequencies of words over all documents."""

import random

from motecraft.llm import nnpu

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, langs):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)


def test_background_frequencies_come_from_all_documents(spark):
    rng = random.Random(33)
    texts = [prose(rng, 20) + (" zzyzx" if i % 100 == 0 else " quuxly" if i % 100 == 50 and i % 200 else "") + (" vile" if i % 50 == 0 else "") for i in range(4000)]
    docs = documents(spark, texts, ["en"] * 4000)
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(4000)], "doc_id long, toxic int")
    model = nnpu.train(docs, labels, nnpu.Settings(unlabelled=100, rounds=20))
    assert {"vile", "zzyzx", "quuxly"} <= set(model["weights"])

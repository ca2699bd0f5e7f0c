"""The pipeline's stages against brute force on small documents, and every query of the operators on the smallest tables."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motecraft.llm import decontamination, kneser_ney, mixing, queries, simhash_ball, surrogates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    leak = prose(rng, 30) + ". " + prose(rng, 8) + "."
    rows = []
    for i in range(120):
        text = prose(rng, 90)
        if i % 12 == 1:
            text = rows[-1][1]
        elif i % 12 == 2:
            text = prose(rng, 90).upper().replace(" ", "!! ")
        elif i % 12 == 3:
            text = f"{prose(rng, 50)} {leak} {prose(rng, 40)}"
        elif i % 12 == 4:
            text = f"{prose(rng, 60)} mail ann.{i:02d}@mail.example.com or 10.0.0.{i} {prose(rng, 20)}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (None, prose(rng, 90), "en", "s1", 1)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120) if i % 12 != 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(rng, 25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, leak


def test_each_stage_against_brute_force(spark, corpus):
    folder, rows, leak = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_leaks", "privacy", "mixture"]
    key = lambda r: repr(tuple(r))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        after = made.collect()
        if name == "quality":
            assert set(map(key, after)) <= set(map(key, before))
            assert not [r for r in after if not r["text"] or "!!" in r["text"]] and len(after) >= 95
        elif name == "near_duplicates":
            texts = [r["text"].lower().split() for r in before]
            sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
            group = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = group[i], group[j]
                        group = [min(a, b) if g in (a, b) else g for g in group]
            first = {}
            for g, r in zip(group, before, strict=True):
                first[g] = min(first.get(g, 2**62), 2**62 if r["doc_id"] is None else r["doc_id"])
            assert Counter(2**62 if r["doc_id"] is None else r["doc_id"] for r in after) == Counter(first.values())
        elif name == "benchmark_leaks":
            assert Counter(map(key, after)) == Counter(key(r) for r in before if leak not in r["text"]) and len(after) < len(before)
        elif name == "privacy":
            now = {r["doc_id"]: r["text"] for r in after}
            for r in before:
                hidden = re.sub(r"\S+@\S+|\b10\.0\.\S+", "#", r["text"])
                assert re.sub(r"\S+@\S+|\b\d+\.\d+\.\S+", "#", now[r["doc_id"]]) == hidden
                assert now[r["doc_id"]] == r["text"] or "@mail" in r["text"]
            assert all(r["n_chars"] == len(r["text"]) or r["doc_id"] is None for r in after) and not any("@mail.example.com" in r["text"] for r in after)
        else:
            copies = Counter(map(key, after))
            assert set(copies) <= set(map(key, before)) and max(copies.values()) <= 2
            words = lambda rs, s: sum(len(r["text"].split()) for r in rs if r["source"] == s)
            targets = {r["source"]: r["target"] for r in mixing.plan_copies(docs).select("row.source", "target").distinct().collect()}
            assert all(abs(words(after, s) - t) <= 0.1 * t + 100 for s, t in targets.items())
        docs = spark.createDataFrame(after, DOCS)


def test_run_is_the_stages_and_repeats(spark, corpus):
    folder, _, _ = corpus
    first, again = ([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()] for _ in range(2))
    assert Counter(first) == Counter(again) and first


def test_stages_on_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame([], DOCS).withColumn("row", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns and made.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_the_whole_table(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    table, key = ("pages", "page_id") if name.startswith(("op5", "op6")) else ("documents", "doc_id")
    everything = [r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()]
    if name.startswith("op1_"):
        items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= {(r["doc_id"], r["item_id"]) for r in rows}
    else:
        assert Counter(r[key] for r in rows) == Counter(everything)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    equals_sql(spark, sf, name)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql_on_odd_documents(spark, tmp_path, name):
    words = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \n\t ", "a", "# * $ !! <b>", f"{words} x {words}", f"{words} {words}", "a b " * 30, "LOUD Été ÉTÉ 漢字 \u00a0 ١٢\n\n é\n é\nx" * 3, "same same " * 4 + "end", "x" * 5000, "-- ** " * 40, "x" * 3]
    rows = [(i if i % 4 else None, t, "s" if i % 3 else None) for i, t in enumerate(texts)] + [(1, "", "s"), (2, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    equals_sql(spark, tmp_path, name)
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def equals_sql(spark, folder, name):
    con = duckdb.connect()
    files = f"{folder}/documents.parquet"
    con.sql(f"create view documents as select * from '{files}{'/*.parquet' if os.path.isdir(files) else ''}'")
    df = queries.QUERIES[name](spark, str(folder))
    want = con.sql(queries.ORACLES[name]).select(*df.columns).fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_operators_ignore_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "mail x.1@y.example.com", "en", "s", 9)], DOCS)
    docs = docs.withColumns({c: F.lit("own") for c in ("row", "id", "key", "known", "mentions", "size", "perplexity", "fp", "_leaks", "body", "language")})
    labels, items = spark.createDataFrame([(1, 1)], "doc_id long, quality int"), spark.createDataFrame([(1, "q q q q q")], "item_id long, text string")
    for made in (
        simhash_ball.one_of_each(docs), mixing.mix(docs), surrogates.replace(docs), kneser_ney.judge(docs, labels).select("row.*"), decontamination.clean(docs, items),
    ):
        assert made.columns == docs.columns and {r["known"] for r in made.collect()} <= {"own"}

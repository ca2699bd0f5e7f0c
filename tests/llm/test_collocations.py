"""Collocations against a plain version and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motecraft.llm import collocations, queries


def plain(rows, least=30, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def odd_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        words = [rng.choice(["a", "B", "of", "the", "é", "No", "x\x00y", "'s", "😀"]) + rng.choice(["", "", ",", ".\n", "\r", "!?"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "de", None, "und", ""])))
    return rows + rows[:20] + [(None, "en"), ("", None), ("New York is big. " * 300, "en"), (" ".join(["z"] * 500), "en"), ("    a\u0085b", "en")]


def test_odd_rows_small_blocks_and_clashing_columns(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("own") for c in ("n", "block", "word", "key", "id", "words", "f", "rank", "phrase")}).repartition(3)
    for least, top, block in ((2, 50, 300), (5, 2000, 40), (30, 2000, 2**20)):
        got = Counter(map(tuple, collocations.mine(docs, least=least, top=top, block=block).collect()))
        assert got == plain(rows, least, top=top)
    assert collocations.mine(docs.where("false")).collect() == []
    assert collocations.mine(docs.where("text = ''")).collect() == []


def test_postings_are_vertical_lists_with_gaps():
    texts = [pa.array([b"a", b"", b"b", b"\n", b"a", b"\n"], pa.binary()), pa.array([b"b", b"\n"], pa.binary())]
    words, counts, at = collocations.postings(texts)
    assert (words.to_pylist(), counts.tolist(), at.tolist()) == (["a", "b"], [2, 2], [0, 3, 1, 5])
    assert np.array_equal(collocations._unpack(collocations._pack(at)), at)


def test_scores_are_exact_beyond_64_bits(spark):
    div = "(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"
    a, left, right = 4 * 10**18 - 1, 4 * 10**18 + 7, 5 * 10**18
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(F.expr(div).cast("long")).first()
    assert row[0] == 2_000_000 * a // (left + right)


def test_query_equals_sql_and_plain(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = queries.op13_collocations(spark, sf)
    want = con.sql(queries.ORACLES["op13_collocations"])
    got = Counter(map(tuple, found.collect()))
    assert found.columns == want.columns and got == Counter(want.fetchall())
    assert got == plain(con.sql("select text, lang from documents").fetchall())
    assert {t for _, t in found.dtypes if t != "string"} == {"bigint"}

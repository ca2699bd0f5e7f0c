"""Queries that SQL can't express against plain Python versions, ids beside nulls, and odd inputs of the operators."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motecraft.llm import common, decontamination, ecoc, html_crf, nnpu, queries, simhash_ball, url_lm, weak_supervision

LONG_ID = 9007199254740993


def prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def texts_of(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ids


def test_long_ids_beside_nulls_are_kept(spark):
    rng = random.Random(41)
    item = prose(rng, 40)
    docs = spark.createDataFrame([(LONG_ID, f"{prose(rng, 50)} {item}", "en"), (None, item, "en"), (3, "x y", "fr")], "doc_id long, text string, lang string").coalesce(1)
    items = spark.createDataFrame([(LONG_ID + 2, item), (None, item)], "item_id long, text string").coalesce(1)
    assert Counter((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()) == Counter(itertools.product((LONG_ID, None), (LONG_ID + 2, None)))
    want = Counter([LONG_ID, None, 3])
    assert Counter(r["doc_id"] for r in nnpu.score(docs, None).collect()) == want
    assert Counter(r["doc_id"] for r in ecoc.predict(docs, ecoc.train(docs)).collect()) == want
    pages = docs.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert Counter(r["page_id"] for r in html_crf.extract(pages).collect()) == want
    assert Counter(r["id"] for r in simhash_ball.classes(docs).collect()) == Counter([LONG_ID, 2**63 - 1, 3])


def test_clashing_columns(spark):
    own = {c: F.lit("own") for c in ("id", "row", "words", "lines", "n_words", "posterior", "fp", "text_hash", "score", "lang_pred", "host", "path", "rule", "verdict", "ratio", "n_chars", "tested", "at", "body", "batch", "gram")}
    docs = spark.createDataFrame([(1, "a b c d", "en"), (2, None, "fr")], "doc_id long, text string, lang string").withColumns(own)
    pages = spark.createDataFrame([(1, "http://com/x", "<p>x"), (2, None, None)], "page_id long, url string, html string").withColumns({c: v for c, v in own.items() if c != "text"})
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("own"), "word": F.lit("own")})
    assert weak_supervision.judge(docs).count() == nnpu.score(docs, nnpu.train(docs, labels)).count() == 2
    assert ecoc.predict(docs, ecoc.train(docs)).count() == simhash_ball.classes(docs).count() == simhash_ball.similar_classes(docs).count() == 2
    assert url_lm.judge(pages).count() == html_crf.extract(pages).count() == 2


# quality rules


def test_posterior_and_verdict_of_all_documents(spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf).collect()}

    def votes(text):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})
        chars, letters = sum(map(len, words)), sum(c.isalpha() for c in text)
        part = lambda a, b: a / b if b else None
        vote = lambda r, good, bad: 0 if r is None else 1 if good(r) else -1 if bad(r) else 0
        between = lambda low, high: (lambda r: r < low, lambda r: r > high)
        n = len(words)
        return (
            vote(part(sum(c in "#*$%&|<>" for c in text), n), *between(0.1, 0.3)),
            vote(part(sum(not any(c.isalnum() for c in w) for w in words), n), *between(0.05, 0.2)),
            vote(part(repeated, n), *between(0.05, 0.2)),
            vote(part(len(lines) - len(set(lines)), len(lines)), *between(0.1, 0.3)),
            vote(part(text.count("!"), n), *between(0.05, 0.2)),
            vote(part(sum(c.isupper() for c in text), letters), *between(0.15, 0.4)),
            vote(part(letters, chars), lambda r: r > 0.85, lambda r: r < 0.7),
            vote(part(chars, n), lambda r: 3 <= r <= 9, lambda r: r < 2 or r > 14),
        ), n < 20 or 100 * repeated > 30 * n

    judged = {i: votes(r["text"] or "") for i, r in texts_of(spark, sf).items()}
    model = weak_supervision.fit(sorted(Counter(v for v, _ in judged.values()).items()), 8)
    for i, (pattern, failed) in judged.items():
        p = model["prior"] * math.prod(model["votes"][True][k][v + 1] for k, v in enumerate(pattern))
        q = (1 - model["prior"]) * math.prod(model["votes"][False][k][v + 1] for k, v in enumerate(pattern))
        assert got[i]["posterior"] == pytest.approx(p / (p + q), abs=1e-9), i
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and p >= q)


# toxicity


def test_toxicity_scores_are_the_classifiers(spark, sf):
    docs = texts_of(spark, sf)
    learned = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    own = [i for i in docs if learned(i)]
    model = nnpu.train(frame.where(F.col("doc_id").isin(own)), labels.where(F.col("doc_id").isin(own)))
    for r in queries.op3_toxicity_nnpu(spark, sf).collect():
        words = set(re.findall(r"[^\W\d_]+", (docs[r["doc_id"]]["text"] or "").lower()))
        held = words | {w[:4] + "*" for w in words if len(w) > 4}
        z = model["bias"] + sum(x for w, x in model["weights"].items() if w in held)
        assert r["held_out"] == (not learned(r["doc_id"])) and r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r["predicted"] == (r["score"] >= 0.5)


# URLs


def test_hosts_paths_and_rules_of_all_pages(spark, sf):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op5_url_markov(spark, sf).collect():
        _, known, rest = (urls[r["page_id"]] or "").partition("://")
        host = re.split("[/?#]", rest)[0] if known else ""
        path = re.split("[?#]", rest[len(host) :])[0] if known else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(x), x, v) for x, v in rules if f".{host}".endswith("." + x.split("/", 1)[0]) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "allow" if r["ratio"] >= 0 else "block")


def test_markov_likelihoods_match_the_definition_and_add_up():
    texts, order = ["abab", "abba", "b", "aabb", "ab"], 3
    model = url_lm.MarkovModel.fit(texts, order)
    chars = [url_lm.START + t + url_lm.END for t in texts]

    def p(context, c):
        total = url_lm.UNSEEN
        for k in range(min(order, len(context)) + 1):
            own = context[len(context) - k :]
            after = Counter(t[i] for t in chars for i in range(1, len(t)) if i >= k and t[i - k : i] == own)
            if k and sum(after.values()) < 2:
                break
            total = (after[c] + len(after) * total) / (sum(after.values()) + len(after))
        return total

    for text in ("", "ab", "abba", "zab", "bbbb"):
        whole = url_lm.START + text + url_lm.END
        want = sum(math.log(p(whole[max(0, i - order) : i], whole[i])) for i in range(1, len(whole)))
        assert model.log_likelihood(text) == pytest.approx(want)
    # 1,021 characters that were never seen share what is left, with the three that were
    for context in (url_lm.START, url_lm.START + "a", "ab", "bab"):
        assert sum(p(context, c) for c in ("a", "b", url_lm.END)) + 1021 * p(context, "z") == pytest.approx(1)


# language


def test_decoding_matches_the_definition(spark):
    rng = random.Random(42)
    letters = {"aa": "etaoin", "bb": "lmnopq", "cc": "xyzetq", "dd": "rstuvw"}
    rows = [(i, prose(rng, 12, letters[lang]), lang) for i, lang in enumerate([*letters] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc.train(docs)
    got = {r["doc_id"]: r for r in ecoc.predict(docs, model).collect()}
    for i, text, _ in rows:
        counts = ecoc.trigram_counts(ecoc.letters(text))
        margins = [sum(n * w for n, w in zip(counts, model.weights[:, b], strict=True) if n) / counts.sum() * model.scale[b] for b in range(model.code.shape[1])]
        loss = {name: sum(t * math.log(1 + math.exp(-c * m)) for t, c, m in zip(model.trust, model.code[k], margins, strict=True)) for k, name in enumerate(model.languages)}
        best = min(loss, key=loss.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss.values()))


def test_bits_that_err_weigh_less():
    trust = ecoc.bit_trust(np.array([0.01, 0.2, 0.5, 0.7]))
    assert trust[0] > trust[1] > trust[2] == trust[3] > 0 and trust.mean() == pytest.approx(2)


def test_bit_errors_are_measured_on_rows_that_were_not_counted(spark):
    rng = random.Random(43)
    rows = [(i, prose(rng, 3, "abcdefgh"), "aa" if i % 2 else "bb") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    code = ecoc.code_matrix(2)
    weights = np.random.default_rng(1).normal(size=(ecoc.BUCKETS, code.shape[1]))
    tested = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(ecoc.TESTED)) == 0).collect()}
    wrong = sum(np.sign(ecoc.trigram_counts(ecoc.letters(t)) @ weights) != code[["aa", "bb"].index(lang)] for i, t, lang in rows if i in tested)
    assert ecoc.bit_errors(docs, ["aa", "bb"], code, weights) == pytest.approx((wrong + 1) / (len(tested) + 2))


# pages


def test_comments_opaque_names_and_deep_pages():
    field = html_crf.default_field()
    story = "<h1>The title of it</h1><p>A story paragraph, which is long enough to be read.</p>"
    want = "The title of it\n\nA story paragraph, which is long enough to be read."
    assert field.extract(f'<article>{story}<div class="user-comments"><p>I liked this article, thanks.</p></div></article>') == want
    assert field.extract(f"<main>{story}</main><div class=kommentare><p>Das war ein guter Artikel.</p></div>") == want
    links = "<div class=x1a><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div>"
    assert field.extract(f'{links}<div class="x1a"><div class="x2b">{story}<table><tr><td>one<td>two</table></div></div>') == want + "\n\none\n\ntwo"
    for page in ("<div>x" * 20_000, "".join(f'<div class="c{i} {chr(97 + i % 26) * (i % 9 + 1)}"><span>x' for i in range(20_000)), "<p>" * 50_000 + "</i>" * 50_000):
        start = time.time()
        field.extract(page)
        assert time.time() - start < 10


def test_known_names_only_leave_out_what_the_field_does_not_know():
    page = '<div class="x y"><p id=z>a</p></div><div class="x">b</div>'
    assert [b.around for b in html_crf.blocks(page)] == [{"<div>", ".x", ".y", "<p>", ".z"}, {"<div>", ".x"}]
    assert [b.around for b in html_crf.blocks(page, {".x", "<p>"})] == [{".x", "<p>"}, {".x"}]


# decontamination


def test_pieces_of_a_long_text_find_what_the_whole_finds(spark, monkeypatch):
    rng = random.Random(44)
    items = [prose(rng, 50) for _ in range(20)]
    index = next(decontamination._shards(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), decontamination.Settings()))
    words = prose(rng, 3000).split()
    for k, item in enumerate(items):
        words[k * 140 : k * 140] = item.split()
    ids = np.array([index.terms.get(w, 0) for w in words])
    whole = sorted(index.candidates(ids))
    for size in (1, 2, 7):
        monkeypatch.setattr(decontamination, "PIECE", size)
        assert sorted(index.candidates(ids)) == whole and {i for _, i, _ in whole} >= set(range(20))


# tables


def test_a_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch_folder(Session)

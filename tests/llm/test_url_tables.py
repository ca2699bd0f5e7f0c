"""The URL models as tables against the ones in memory, over all URLs, and the threshold against all cuts."""

import random

import pytest
from pyspark.sql import functions as F

from motecraft.llm import url_lm


def urls(rng, n, words):
    return [f"{rng.choice(words)}{rng.choice(words)}.org/{rng.choice(words)}/{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("size", [3, 6000])
def test_tables_give_the_ratios_of_models_of_all_urls(spark, size):
    rng = random.Random(31)
    sides = [sorted({*urls(rng, size, w)}) for w in (["news", "post", "\u00e4on"], ["shop", "cheap", "post"])]
    others = ["", "x", "\x02\x02", "\U0001f600/p", "news" * 50, *urls(rng, 20, ["news", "cheap", "zz"])]
    rows = [(t, k) for k, side in enumerate(sides) for t in side if t not in sides[1 - k]] + [(t, 2) for t in others]
    given = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "id long, text string, of int")
    memory = url_lm.Ratio(*(url_lm.MarkovModel.fit([t for t, k in rows if k == side]) for side in (0, 1)))
    found = {r["text"]: r["raw"] for r in url_lm.raw_ratios(given).collect()}
    assert len(found) == len({t for t, _ in rows})
    for text in [*others, *sides[0][:20], *sides[1][:20]]:
        assert found[text] == pytest.approx(memory.raw(text), abs=1e-8)


def test_every_url_that_a_rule_decides_teaches_or_calibrates(spark):
    paths = [f"{i:05d}" for i in range(6000)]
    pages = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in ("a.com", "b.net/es") for p in paths)], "page_id long, url string")
    got = url_lm.judge(pages).collect()
    assert len(got) == 12000 and {r["verdict"] for r in got if r["rule"] == "com/"} == {"allow"}
    marked = pages.select(F.concat(F.lit("x"), F.col("url")).alias("text"), F.lit(0).alias("of"))
    assert url_lm.counts(marked).where(F.col("gram") == "x").first()["n_0"] == 12000


def test_threshold_is_the_best_of_all_cuts(spark):
    rng = random.Random(32)
    for n in (2, 40, 400):
        rows = [(round(rng.gauss(0.5 * good, 1), 1), bool(good)) for good in (0, 1) for _ in range(n)]
        cut = url_lm.threshold(spark.createDataFrame(rows, "raw double, good boolean").repartition(7))
        error = lambda c: sum(r < c for r, g in rows if g) + sum(r >= c for r, g in rows if not g)  # noqa: E731, B023
        every = sorted({r for r, _ in rows})
        assert error(cut) == min(error(c) for c in [*((a + b) / 2 for a, b in zip(every, every[1:], strict=False)), every[0] - 1])
    assert url_lm.threshold(spark.createDataFrame([(0.5, True), (0.5, False)], "raw double, good boolean")) < 0.5


def test_few_urls_of_a_side(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x"), (1, "http://b.net/es/1"), (2, "http://q.org/"), (3, "http://q.org/"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_lm.judge(pages).collect()}
    assert [got[i]["verdict"] for i in (0, 1)] == ["allow", "block"] and got[2]["ratio"] == got[3]["ratio"] and len(got) == 5


def test_no_table_that_grows_with_the_urls_is_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(url_lm, "materialize", lambda df, make=url_lm.materialize: (plans.append(plan(df)), make(df))[1])
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i in range(60) for h in ("a.com", "b.net/es", "q.org")], "page_id long, url string")
    plans.append(plan(url_lm.judge(pages)))
    assert len(plans) > 8 and sum("SortMergeJoin" in p for p in plans) > 6
    assert not [p for p in plans if "BroadcastHashJoin" in p]

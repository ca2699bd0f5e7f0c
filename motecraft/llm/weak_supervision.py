"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation-maximisation estimates, for good and for
bad documents, how often each rule casts each vote, from the counts of the vote patterns of all documents (at most
3^rules rows). The posterior probability that a document is good then stands in for "all rules must pass".

Defined cases: a null or empty text has no words, fails the base rules and takes the posterior of a document on which
every rule abstains; long texts are counted whole; a posterior at the threshold passes; repeated rows are judged one by one; an empty table gives an empty result; columns of the input
other than id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize

WINDOW = 8
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text, first ones included.

    Windows are compared by 64-bit hashes. Only texts with a repeated window are sorted.
    """

    def spans(hashes: Column) -> Column:
        indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            n = F.size(rows)
            twice = F.filter(
                rows,
                lambda row, k: F.when((k > 0) & (F.get(rows, k - 1)["h"] == row["h"]), True)
                .when((k < n - 1) & (F.get(rows, k + 1)["h"] == row["h"]), True)
                .otherwise(False),
            )
            return F.sort_array(F.transform(twice, lambda row: row["i"].cast("long")))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        add = lambda acc, p: F.struct((acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n"), (p + width).alias("end"))
        return F.aggregate(let(indexed, starts), zero, add, lambda acc: acc["n"])

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (width - 1)), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(width))))

    counted = let(windows_of(words, windows, width), lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), spans(hashes)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0).cast("long"))


def windows_of(words: Column, windows, width: int) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts that the base and the voting rules read: one row per document."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = read.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    t = F.col("text")
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _removed(t, WORD).alias("word_chars"),
        _removed(t, r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare_words"),
        _removed(t, r"!+").alias("n_exclaim"),
        _removed(t, r"\p{Lu}+").alias("n_upper"),
        _removed(t, r"\p{L}+").alias("n_letters"),
    )


def _vote(ratio: Column, good, bad) -> Column:
    """+1 where `good(ratio)`, -1 where `bad(ratio)`, else and for a null ratio 0."""
    return F.when(good(ratio), 1).when(bad(ratio), -1).otherwise(0)


def rules() -> dict[str, Column]:
    """The voting rules, each a column of -1, 0 or 1 over `features`."""
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    under = lambda x: lambda r: r < x
    over = lambda x: lambda r: r > x
    return {
        "symbols": _vote(part("n_symbols", "n_words"), under(0.1), over(0.3)),
        "bare_symbols": _vote(part("n_bare_words", "n_words"), under(0.05), over(0.2)),
        "repeats": _vote(part("n_repeat_words", "n_words"), under(0.05), over(0.2)),
        "duplicate_lines": _vote(part("n_dup_lines", "n_lines"), under(0.1), over(0.3)),
        "exclamations": _vote(part("n_exclaim", "n_words"), under(0.05), over(0.2)),
        "capitals": _vote(part("n_upper", "n_letters"), under(0.15), over(0.4)),
        "letters": _vote(part("n_letters", "word_chars"), over(0.85), under(0.7)),
        "word_length": _vote(part("word_chars", "n_words"), lambda r: r.between(3, 9), lambda r: (r < 2) | (r > 14)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100) -> dict:
    """Expectation-maximisation over counted vote patterns.

    Returns `prior` (of good) and, for each class and rule, the probabilities of the votes -1, 0 and 1. They start at
    rules that seldom object to a good document and each see some of the faults of a bad one, and keep a fiftieth of all
    documents as a prior count of that start, so that the classes can't turn into something else than good and bad.
    """
    start = {True: (0.005, 0.045, 0.95), False: (0.25, 0.15, 0.60)}
    votes = {y: [list(start[y]) for _ in range(n_rules)] for y in (True, False)}
    prior, total = 0.8, sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        counts = {y: [[total / 50 * p for p in start[y]] for _ in range(n_rules)] for y in (True, False)}
        good = 0.0
        for pattern, n in patterns:
            p = posterior(pattern, prior, votes)
            good += n * p
            for k, v in enumerate(pattern):
                counts[True][k][v + 1] += n * p
                counts[False][k][v + 1] += n * (1 - p)
        before, prior = prior, min(0.99, max(0.01, good / total))
        votes = {y: [[c / sum(row) for c in row] for row in counts[y]] for y in (True, False)}
        if abs(before - prior) < 1e-9:
            break
    return {"prior": prior, "votes": votes}


def posterior(pattern, prior: float, votes: dict) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(votes[True][k][v + 1] / votes[False][k][v + 1]) for k, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def accuracies(model: dict) -> list[float]:
    """Of each rule: how often its votes are right where it doesn't abstain."""
    p = model["prior"]
    right = [p * g[2] + (1 - p) * b[0] for g, b in zip(model["votes"][True], model["votes"][False], strict=True)]
    cast = [p * (g[0] + g[2]) + (1 - p) * (b[0] + b[2]) for g, b in zip(model["votes"][True], model["votes"][False], strict=True)]
    return [r / c if c else 0.5 for r, c in zip(right, cast, strict=True)]


def posterior_column(model: dict, names: list[str]) -> Column:
    """The posterior as an expression over vote columns."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, name in enumerate(names):
        at = [math.log(model["votes"][True][k][v] / model["votes"][False][k][v]) for v in range(3)]
        odds = odds + F.when(F.col(name) == -1, at[0]).when(F.col(name) == 0, at[1]).otherwise(at[2])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, base verdict, posterior and `kept` of every document."""
    named = rules()
    voted = materialize(features(docs, doc_id, text)).withColumns({f"vote_{k}": v for k, v in named.items()})
    names = [f"vote_{k}" for k in named]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    model = fit(sorted(patterns), len(names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumns({"base_failed": failed, "posterior": posterior_column(model, names)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))

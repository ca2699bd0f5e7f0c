"""Benchmark decontamination: a BM25 index of the test items, searched by every passage of the training texts.

Items are indexed in segments of at most 64 words, documents searched in passages of 128 words that begin every 64, so
that each segment's words fit in one passage. A term's impact on a segment is its BM25 weight as a share of the weight
of the whole segment; a passage finds all segments whose impacts add up to `threshold`.

The search is block-max WAND, run over a document's passages together: segments are in blocks of eight, and lists hold
a term's largest impact in a block. Terms that are common in the items, up to `spare` of a segment's weight, are not
opened at first: their largest sum is a constant for the block. A block whose bound over a passage stays under the
threshold is skipped whole; only the others are opened and scored exactly.

A segment found leads to its item, which is verified: of the five-word shingles of its question, and of those of its
answer, `overlap` must stand in the document around the passage. The question is the text up to the last line or
sentence, the answer that last part; a single sentence is both.

The index is broadcast in shards of at most `shard_words` words of items, one search per shard.

Defined cases: null, empty and wordless texts and items match nothing; texts of any length are searched whole, in pieces;
items with equal texts are all reported;
repeated rows are reported each; empty tables give an empty result; columns other than ids and texts are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_given, materialize

_WORDS = re.compile(r"[^\W_]+")
_LAST_PART = re.compile(r"^(.*\S)\s*\n\s*(\S.*)$|^(.*[.!?])\s+(\S.*)$", re.S)


#: Passages of a text that are bounded at once.
PIECE = 128


@dataclass(frozen=True)
class Settings:
    """BM25 constants, sizes in words, and what counts as found and as verified."""

    k1: float = 1.2
    b: float = 0.75
    segment: int = 64
    block: int = 8
    threshold: float = 0.5
    spare: float = 0.2
    shingle: int = 5
    overlap: float = 0.8
    shard_words: int = 1_000_000


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item's two parts."""
    m = _LAST_PART.match((text or "").strip())
    parts = [words_of(x) for x in ((m[1] or m[3], m[2] or m[4]) if m else (text, text))]
    return (parts[0], parts[1]) if all(parts) else (words_of(text),) * 2


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@dataclass
class Index:
    """Segments of some items with the impacts of their terms, and the block-level lists."""

    settings: Settings
    terms: dict[str, int]
    segments: list[tuple[int, dict[int, float]]]
    items: list[tuple[object, list[str], list[str], int]]
    starts: np.ndarray
    blocks: np.ndarray
    bounds: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[object, str]], frequency: dict[str, int], n_segments: int, mean_length: float, s: Settings) -> Index:
        """`frequency`, `n_segments` and `mean_length` are of all segments of the benchmark, not of this shard alone."""
        terms: dict[str, int] = {}
        segments, kept = [], []
        for item, text in items:
            question, answer = question_and_answer(text)
            whole = words_of(text)
            kept.append((item, question, answer, len(whole)))
            for words in segment(whole, s.segment):
                long = s.k1 * (1 - s.b + s.b * len(words) / mean_length)
                weight = {w: math.log(1 + (n_segments - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (s.k1 + 1) / (n + long) for w, n in Counter(words).items()}
                total = sum(weight.values())
                segments.append((len(kept) - 1, {terms.setdefault(w, len(terms) + 1): x / total for w, x in weight.items()}))
        common = {terms[w]: n for w, n in frequency.items() if w in terms}
        n_blocks = -(-len(segments) // s.block)
        lists: list[dict[int, float]] = [{} for _ in range(len(terms) + 1)]
        rest = np.zeros(n_blocks)
        for i, (_, impacts) in enumerate(segments):
            spared = 0.0
            for t in sorted(impacts, key=lambda t: (-common[t], t)):
                if spared + impacts[t] <= s.spare:
                    spared += impacts[t]
                else:
                    lists[t][i // s.block] = max(lists[t].get(i // s.block, 0.0), impacts[t])
            rest[i // s.block] = max(rest[i // s.block], spared)
        sizes = np.array([len(x) for x in lists])
        flat = [(b, x) for held in lists for b, x in sorted(held.items())]
        return cls(s, terms, segments, kept, np.concatenate(([0], np.cumsum(sizes))), np.array([b for b, _ in flat], np.int64), np.array([x for _, x in flat], np.float64), rest)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Passage start, segment and score of all segments that reach the threshold.

        A long text is searched in pieces that share a unit, so that the bounds never take more than a piece's memory.
        """
        size = self.settings.segment
        for first in range(0, max(size, len(ids) - size), PIECE * size):
            for start, i, score in self._piece(ids[first : first + (PIECE + 1) * size]):
                yield first + start, i, score

    def _piece(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        s, n_blocks = self.settings, len(self.rest)
        units = -(-len(ids) // s.segment)
        at = np.flatnonzero(ids)
        first, sizes = self.starts[ids[at]], self.starts[ids[at] + 1] - self.starts[ids[at]]
        ends = np.cumsum(sizes)
        flat = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        key = np.repeat(at // s.segment, sizes) * n_blocks + self.blocks[flat]
        bound = np.bincount(key, self.bounds[flat], units * n_blocks).reshape(units, n_blocks)
        bound = bound[:-1] + bound[1:] if units > 1 else bound
        for unit, block in zip(*np.nonzero(bound + self.rest >= s.threshold - 1e-9), strict=True):
            start = int(unit) * s.segment
            present = set(ids[start : start + 2 * s.segment].tolist())
            for i in range(block * s.block, min((block + 1) * s.block, len(self.segments))):
                score = sum(x for t, x in self.segments[i][1].items() if t in present)
                if score >= s.threshold - 1e-9:
                    yield start, i, score

    def search(self, text: str | None) -> list[tuple[object, float, float, float]]:
        """Item, score, question overlap and answer overlap of the verified items in a text."""
        words, s = words_of(text), self.settings
        ids = np.fromiter((self.terms.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return []
        best: dict[int, tuple[float, float, float]] = {}
        for start, i, score in self.candidates(ids):
            k = self.segments[i][0]
            _, question, answer, length = self.items[k]
            around = shingles_in(words[max(0, start - length) : start + 2 * s.segment + length], question, answer, s.shingle)
            if min(around) >= s.overlap:
                best[k] = max(best.get(k, (0.0, 0.0, 0.0)), (score, *around))
        return [(self.items[k][0], *found) for k, found in sorted(best.items())]


def shingles_in(passage: list[str], question: list[str], answer: list[str], size: int) -> tuple[float, float]:
    """The shares of the question's and of the answer's shingles that stand in the passage."""
    shares = []
    for part in (question, answer):
        wanted = shingles(part, size)
        k = min(size, len(part))
        here = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
        shares.append(len(wanted & here) / len(wanted) if wanted else 0.0)
    return shares[0], shares[1]


def segment(words: list[str], size: int) -> list[list[str]]:
    """Even parts of at most `size` words."""
    n = -(-len(words) // size)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


def _shards(benchmark: DataFrame, s: Settings) -> Iterator[Index]:
    """The benchmark's index, shard by shard, with term statistics of the whole of it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, len(p), sorted(set(p))) for h, t in zip(batch["at"], batch["text"], strict=True) for p in segment(words_of(t), s.segment)]
            yield pd.DataFrame(rows, columns=["at", "n", "terms"])

    items = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("at")).where("text is not null")
    cuts = materialize(items.select("at", "text").mapInPandas(cut, "at long, n long, terms array<string>"))
    whole = cuts.agg(F.count("*").alias("segments"), F.sum("n").alias("words")).first()
    if not whole["segments"]:
        return
    frequency = materialize(cuts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    n_shards = -(-whole["words"] // s.shard_words)
    shard = F.pmod("at", F.lit(n_shards))
    for k in range(n_shards):
        own = sorted(((r["item_id"], r["text"]) for r in items.where(shard == k).toLocalIterator()), key=repr)
        own = [x for x in own if words_of(x[1])]
        terms = cuts.where(shard == k).select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in frequency.join(terms, "term").toLocalIterator()}
        if own:
            yield Index.build(own, counts, whole["segments"], whole["words"] / whole["segments"], s)


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`doc_id`, `item_id`, `score`, `question_overlap`, `answer_overlap`: a row for each item in each document."""
    read = docs.select(F.col("doc_id").cast("string"), "text")
    schema = "doc_id string, item_id string, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _shards(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(i, None if item is None else str(item), *hit) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for item, *hit in shared.value.search(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(read.mapInPandas(run, schema))
    return as_given(as_given(found, "doc_id", docs), "item_id", benchmark)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` that hold no item; they are tested where they are read, not joined with the finds."""
    kept, flag = docs, "_".join(["leaks", *docs.columns])
    for index in _shards(benchmark, settings):
        kept = kept.withColumn(flag, _leaking(docs.sparkSession.sparkContext.broadcast(index))("text")).where(~F.col(f"`{flag}`")).drop(flag)
    return kept


def _leaking(shared):
    @F.pandas_udf("boolean")
    def leaking(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(shared.value.search(t))).astype(bool)

    return leaking

"""Phrase collocations from vertical positional inverted lists.

A task numbers the words it reads, with gaps between pieces, and keeps them in blocks of a language as lists: of each word
the positions where it stands. Phrases grow a word at a time: the positions of a frequent phrase are merge-joined with the
postings of frequent words, shifted by the phrase's length; where the phrase without its first word isn't frequent
either, no longer one can be. The length of the list that results is the exact frequency in the block. A block's lengths are summed
over all blocks in a shuffle by phrase, to which a block sends a row for each phrase, however often it stands there, so no
phrase is a hot key. Which of its phrases are frequent returns to the block by a join; the blocks' lists lie in tables
bucketed by block and are never shuffled.

Phrases are then rows: their cuts are scored in exact decimals, those within longer ones of nearly their frequency are
dropped, and the first of each language are ranked in two steps, by shares of a language and then by language.

Defined cases: a null or empty text has no words; a null language is `und`, as is the language of that name; a long text
is read whole and counts in one block; repeated rows count each; equal scores are ordered by frequency and then by the
phrase's bytes, so there are no ties; an empty table gives an empty result; other columns don't matter, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize

#: Least occurrences and most words of a phrase, phrases reported for a language, parts of a longer phrase's frequency.
LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, (80, 100)
#: Positions after which a block is closed, and items that a task gathers before it returns them to the blocks.
BLOCK, RETURNED = 2**20, 2**20
#: Shares of a language that are ranked by themselves first.
SHARES = 64
#: Separators of pieces become line ends and tabs blanks.
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def _pack(numbers: np.ndarray) -> bytes:
    """Rising lists of positions, one after the other: differences, with their bytes apart."""
    steps = np.diff(numbers.astype(np.int32), prepend=np.int32(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int64)


def postings(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts (each cut into words, with line ends between pieces), their counts, and their positions word by word."""
    coded = pa.concat_arrays(texts).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    blank, cut = (words.index(pa.scalar(x, pa.binary())).as_py() for x in (b"", b"\n"))
    codes = codes[codes != blank]
    at = np.flatnonzero(codes != cut)
    order = np.argsort(codes[at], kind="stable")
    counts = np.bincount(codes[at], minlength=len(words))
    return words.filter(pa.array(counts > 0)).cast(pa.string()), counts[counts > 0], at[order]


def _blocks(docs: DataFrame, text: str, lang: str, size: int, buckets: int) -> DataFrame:
    """`block`, `lang`, `n` (words), `words`, their `counts` and their packed `positions`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 32, {}

        def block(name: str) -> pa.RecordBatch:
            nonlocal at
            words, counts, positions = postings(held.pop(name)[0])
            at += 1
            fields = [pa.array([at], pa.int64()), pa.array([name], pa.string()), pa.array([len(positions)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(positions)], pa.binary())]
            return pa.RecordBatch.from_arrays(fields, names=["block", "lang", "n", "words", "counts", "positions"])

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (content.as_py() or "").encode().lower().translate(_CUTS)
                own = held.setdefault(name, ([], [0]))
                own[0].append(pa.array([*data.replace(b"\n", b" \n ").split(b" "), b"\n"], pa.binary()))
                own[1][0] += len(own[0][-1])
                if own[1][0] >= size:
                    yield block(name)
        for name in list(held):
            yield block(name)

    made = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.col(f"`{text}`"))
    return bucketed(made.mapInArrow(run, "block long, lang string, n long, words array<string>, counts array<long>, positions binary"), "block", buckets)


def frequent(rows: DataFrame, keys: list[str], own: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The keys of `rows` (`keys`, `n`, `block`, `own`) whose `n` sum up to `least` at least, and what they are in each block.

    Returns `keys`, `total` and `id`, and of each block the arrays `own` and `ids`. The rows of a key meet sorted in one
    task, which sums them up as they pass and gathers what goes back to a block, a row for each block. Ids are dense: a
    task counts its keys, and the counts of the tasks before are added.
    """
    kinds = dict(rows.dtypes)
    names = [*keys, "total", "part", "place", "block", "own", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rest = TaskContext.get().partitionId(), 0, None
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def starts(t: pa.Table) -> np.ndarray:
            new = np.ones(len(t), bool)
            if len(t) > 1:
                same = [pc.equal(t[k].slice(1), t[k].slice(0, len(t) - 1)).to_numpy() for k in keys]
                new[1:] = ~np.logical_and.reduce(same)
            return np.flatnonzero(new)

        def summed(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            total = np.add.reduceat(t["n"].to_numpy(), at)
            keep, sizes = total >= least, np.diff(at, append=len(t))
            place = made + np.cumsum(keep) - 1
            made += int(keep.sum())
            on = np.repeat(keep, sizes)
            back.append((t["block"].to_numpy()[on], t[own].to_numpy()[on].astype(np.int64), np.repeat(place, sizes)[on]))
            n = int(keep.sum())
            firsts = t.select(keys).take(pa.array(at[keep])).combine_chunks()
            fields = [*(firsts[k].combine_chunks() for k in keys), pa.array(total[keep], pa.int64()), pa.array(np.full(n, part), pa.int64()), pa.array(place[keep], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(fields, names=names)

        def returned() -> pa.RecordBatch:
            blocks, owns, places = (np.concatenate(x) for x in zip(*back, strict=True))
            back.clear()
            order = np.argsort(blocks, kind="stable")
            each, first = np.unique(blocks[order], return_index=True)
            n, edge = len(each), pa.array([*first, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[order], pa.int64())) for x in (owns, places)]
            nothing = [pa.nulls(n, {"string": pa.string(), "bigint": pa.int64()}[kinds[k]]) for k in keys]
            return pa.RecordBatch.from_arrays([*nothing, pa.nulls(n, pa.int64()), pa.array(np.full(n, part), pa.int64()), pa.nulls(n, pa.int64()), pa.array(each, pa.int64()), *lists], names=names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if len(t):
                at = starts(t)
                rest = t.slice(at[-1])
                if at[-1]:
                    yield summed(t.slice(0, at[-1]), at[:-1])
                    if sum(len(x) for x, _, _ in back) >= RETURNED:
                        yield returned()
        if rest is not None:
            yield summed(rest, starts(rest))
        if back:
            yield returned()

    spread = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = materialize(spread.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", total long, part long, place long, block long, own array<long>, places array<long>"))
    counts = found.where("block IS NULL").groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = found.join(F.broadcast(before), "part")  # a row for each task of the shuffle
    one = placed.where("block IS NULL").select(*keys, "total", (F.col("before") + F.col("place")).alias("id"))
    per_block = placed.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("own", F.transform("places", lambda x: x + F.col("before")).alias("ids"))).alias("parts"))
    return one, per_block.select("block", F.flatten("parts.own").alias("own"), F.flatten("parts.ids").alias("ids"))


class _Lists:
    """A block's position lists: of phrases (of `length` words) and of the words that may follow them, by position."""

    def __init__(self, block: int, phrases: np.ndarray, at: np.ndarray, words: np.ndarray, word_at: np.ndarray):
        order, word_order = np.argsort(at, kind="stable"), np.argsort(word_at, kind="stable")
        self.block, self.phrases, self.at, self.words, self.word_at = block, phrases[order], at[order], words[word_order], word_at[word_order]

    @staticmethod
    def _meet(wanted: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in sorted positions each of other sorted positions is, and whether."""
        place = np.minimum(np.searchsorted(there, wanted), max(0, len(there) - 1))
        return place, there[place] == wanted if len(there) else np.zeros(len(wanted), bool)

    def longer(self, length: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (phrase and following word in one number) and positions of phrases that are a word longer."""
        place, hit = self._meet(self.at + length, self.word_at)
        hit &= self._meet(self.at + 1, self.at)[1] if length > 1 else True
        return self.phrases[hit] * n_words + self.words[place[hit]], self.at[hit]


_STATE = "block long, phrases array<long>, phrase_counts array<long>, phrase_at binary, words array<long>, word_counts array<long>, word_at binary"


def _state(block: int, phrases: np.ndarray, at: np.ndarray, words: np.ndarray, word_at: np.ndarray) -> pa.RecordBatch:
    fields = [pa.array([block], pa.int64())]
    for ids, places in ((phrases, at), (words, word_at)):
        order = np.lexsort((places, ids))
        own, counts = np.unique(ids, return_counts=True)
        fields += [pa.array([own], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(places[order])], pa.binary())]
    return pa.RecordBatch.from_arrays(fields, names=[c.split()[0] for c in _STATE.split(", ")])


def _read(batch: pa.RecordBatch, i: int) -> _Lists:
    values = lambda name: batch.column(name)[i].values.to_numpy()
    return _Lists(batch.column("block")[i].as_py(), np.repeat(values("phrases"), values("phrase_counts")), _unpack(batch.column("phrase_at")[i].as_py()), np.repeat(values("words"), values("word_counts")), _unpack(batch.column("word_at")[i].as_py()))


def _words_of_blocks(blocks: DataFrame, kept: DataFrame, buckets: int) -> DataFrame:
    """The lists of frequent words, by id: the phrases of one word and the words that may follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                counts = batch.column("counts")[i].values.to_numpy()
                ids = np.full(len(counts), -1, np.int64)
                ids[batch.column("own")[i].values.to_numpy()] = batch.column("ids")[i].values.to_numpy()
                every, at = np.repeat(ids, counts), _unpack(batch.column("positions")[i].as_py())
                on = every >= 0
                yield _state(batch.column("block")[i].as_py(), every[on][:0], at[:0], every[on], at[on])

    joined = blocks.select("block", "counts", "positions").join(kept, "block")
    return bucketed(joined.mapInArrow(run, _STATE), "block", buckets)


def _first(lists: _Lists, length: int) -> _Lists:
    """Phrases of one word are the words themselves."""
    return lists if length > 1 else _Lists(lists.block, lists.words, lists.word_at, lists.words, lists.word_at)


def _extended(state: DataFrame, length: int, n_words: int) -> DataFrame:
    """`key`, `n` and `block` of the phrases that are a word longer, each once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lists = _first(_read(batch, i), length)
                keys, counts = np.unique(lists.longer(length, n_words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts, pa.int64()), pa.array(np.full(len(keys), lists.block))], names=["key", "n", "block"])

    return state.mapInArrow(run, "key long, n long, block long")


def _advanced(state: DataFrame, kept: DataFrame, length: int, n_words: int, buckets: int) -> DataFrame:
    """The lists of frequent phrases that are a word longer, and of the words at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lists = _first(_read(batch, i), length)
                own, ids = batch.column("own")[i].values.to_numpy(), batch.column("ids")[i].values.to_numpy()
                order = np.argsort(own)
                own, ids = own[order], ids[order]
                keys, at = lists.longer(length, n_words)
                place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[place] == keys
                ends = np.isin(lists.word_at, at[hit] + length)
                yield _state(lists.block, ids[place[hit]], at[hit], lists.words[ends], lists.word_at[ends])

    return bucketed(state.join(kept, "block").mapInArrow(run, _STATE), "block", buckets)


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All phrases (`lang`, `words`, `f`) of up to `longest` words with `least` occurrences, and all words' number `n` per `lang`."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, text, lang, block, buckets)
    sizes = materialize(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    each = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "item")).select("lang", F.col("item.words").alias("word"), F.col("item.counts").alias("n"), "block", "code")
    found, kept = frequent(each, ["lang", "word"], "code", least)
    state = _words_of_blocks(blocks, kept, buckets)
    words = materialize(found.select("id", "lang", F.array("word").alias("words"), F.col("total").alias("f")))
    discard(blocks)
    n_words = max(1, words.count())
    levels, n_left = [words], n_words
    for length in range(1, longest):
        if n_left * n_words >= 2**63:
            raise ValueError("more frequent phrases than a number of 64 bits can tell apart")
        found, kept = frequent(_extended(state, length, n_words), ["key"], "key", least)
        left, last = F.expr(f"key div {n_words}L"), F.col("key") % n_words
        grown = found.select("id", left.alias("left"), last.alias("last"), F.col("total").alias("f"))
        begun = levels[-1].select(F.col("id").alias("left"), "lang", F.col("words").alias("begun"))
        ended = words.select(F.col("id").alias("last"), F.col("words").alias("ended"))
        levels.append(materialize(grown.join(begun, "left").join(ended, "last").select("id", "lang", F.concat("begun", "ended").alias("words"), "f")))
        n_left = levels[-1].count()
        if length + 1 < longest:
            state, before = _advanced(state, kept, length, n_words, buckets), state
            discard(before)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.drop("id"), sizes


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The first `top` phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n` and `score`."""
    every, sizes = phrases(docs, text=text, lang=lang, least=least, longest=longest, block=block)
    found = every.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))
    parts = every.where(F.size("words") < longest).select("lang", F.array_join("words", " ").alias("part"), "f")
    cut = found.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ")})
    for side, out in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(out)), ["lang", side])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))").cast("long")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    longer = found.where(F.size("words") > 2).select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(SHARE[1] * F.col("longer") < SHARE[0] * F.col("a"), F.lit(True)))
    rows = alone.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = rows.withColumn("share", F.abs(F.hash("phrase")) % SHARES)
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Byte-level BPE of whole corpora: every distinct pre-token is encoded once, and ids return to where it stands.

A task cuts the texts it reads into pre-tokens and keeps them in blocks: the block's distinct pre-tokens, and for each
position in order the number of its pre-token among them. The distinct ones are exploded into lists, one for each shard
of a hash, and shuffled; a shard's task sees its lists from all blocks and makes each pre-token's merges once. The ids go
back to the blocks by a join, and a block puts them together by position. As a block names a pre-token only once, no
word is a hot key, and lists in order compress to a few bytes a word. Decoding joins ids with the token-byte table, which
is bounded and therefore sent to the tasks: no row moves.

Pre-tokens are cut as the tokenizer's own library does. Its tables of letters, digits and white space are asked from the
library, as other engines follow other versions of Unicode.

Defined cases: a null text counts as empty and an empty text has no ids; a null list of ids decodes to no bytes; an id
that the table lacks fails the job with an error; a text stays in one block, however long, so it must fit in a task as a
row does; repeated rows are encoded each; the order of merges is by rank, then from the left, which leaves no tie; an
empty table gives an empty result; all columns of the input may come along in `row`, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import bucketed

#: Pre-tokens after which a block is closed.
BLOCK = 2**20
#: Entries a vocabulary may have: it is sent to every executor.
MOST_TOKENS = 2**20
#: Bytes of a pre-token up to which all candidates are looked at for each merge; a rank beyond all.
SHORT, NEVER = 64, 2**62
#: Shards of distinct pre-tokens for each partition of a shuffle.
SHARDS = 4


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ids, from lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is too large to be sent to all executors")
    return ranks


@functools.cache
def _members(kind: str) -> frozenset[str]:
    """The characters that the library takes for a class such as \\p{L}."""
    engine = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(engine.decode(engine.encode_ordinary(every)))


def _ranges(kind: str) -> str:
    """A class as ranges of characters below 0x10000, for the inside of brackets."""
    points = np.array(sorted(p for p in map(ord, _members(kind)) if p < 0x10000))
    breaks = np.flatnonzero(np.diff(points) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(points[np.r_[0, breaks + 1]], points[np.r_[breaks, len(points) - 1]], strict=True))


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into the matches of a tokenizer's pattern.

    \\p{L}, \\p{N}, \\s and \\S are written out as ranges. Characters beyond 0xFFFF are stood in for by one below of the same
    class while the text is matched.
    """
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ("[", "]"):
            inside = part == "["
        elif part == r"\S":
            part = f"[^{_ranges(chr(92) + 's')}]"
        elif part == r"\s" or part.startswith(r"\p"):
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        out.append(part)
    own = re.compile("".join(out))
    letters, digits = _members(r"\p{L}"), _members(r"\p{N}")

    def like(found: re.Match) -> str:
        return "\xaa" if found[0] in letters else "\xb2" if found[0] in digits else "\xa7"

    def split(text: str) -> list[str]:
        if _BEYOND.search(text):
            return [text[m.start() : m.end()] for m in own.finditer(_BEYOND.sub(like, text))]
        return own.findall(text)

    return split


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of its neighbouring parts those of the lowest rank are merged first, from the left.

    In a long one candidates wait in a heap, so that n bytes take n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT:
        parts = [word[i : i + 1] for i in range(n)]
        pairs = [ranks.get(word[i : i + 2], NEVER) for i in range(n - 1)]
        while pairs and (low := min(pairs)) < NEVER:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return [ranks[part] for part in parts]
    end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        middle = end[i]
        if gone[i] or middle >= n or gone[middle] or end[middle] != stop:
            continue  # one of both parts has been merged with another since
        gone[middle], end[i] = True, stop
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(waiting, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := ranks.get(word[left:stop])) is not None:
            heapq.heappush(waiting, (rank, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def _pack(lengths: np.ndarray, data: bytes) -> bytes:
    """Lists of bytes or numbers, compressed: lengths of the items, then the items."""
    return zstandard.compress(np.uint32(len(lengths)).tobytes() + _planes(lengths.astype(np.uint32)) + data, 3)


def _unpack(packed: bytes) -> tuple[np.ndarray, memoryview]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return _whole(memoryview(raw)[4 : 4 + 4 * n]), memoryview(raw)[4 + 4 * n :]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their bytes apart, as the high ones are mostly zero."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(planes: memoryview | bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _lists(words: pa.StringArray, shards: int) -> tuple[list[bytes | None], np.ndarray]:
    """Distinct words dealt to shards, each shard's in order and packed, and the number of each word in the order of all shards."""
    dealt = np.fromiter((zlib.crc32(w) % shards for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    order = pc.sort_indices(pa.table({"shard": dealt, "word": words}), [("shard", "ascending"), ("word", "ascending")]).to_numpy()
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    ordered, ends = words.take(pa.array(order)), np.searchsorted(dealt[order], np.arange(shards + 1))
    edges = np.frombuffer(ordered.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = memoryview(ordered.buffers()[2] or b"")
    return [_pack(np.diff(edges[a : b + 1]), bytes(data[edges[a] : edges[b]])) if b > a else None for a, b in zip(ends, ends[1:], strict=False)], number


def _blocks(rows: DataFrame, pattern: str, size: int, shards: int) -> DataFrame:
    """Blocks of `rows` (`row`, `content`): their `rows`, the `sizes` of their texts, the packed `lists` of distinct pre-tokens and the `codes` of all."""
    schema = StructType.fromDDL("block long, sizes array<int>, codes binary, lists array<binary>").add("rows", ArrayType(rows.schema["row"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, split = TaskContext.get().partitionId() << 32, splitter(pattern)
        found, held, n = [], [], 0

        def block() -> pa.RecordBatch:
            own, coded = pa.concat_arrays(held), pa.concat_arrays(found).dictionary_encode()
            lists, number = _lists(coded.dictionary, shards)
            codes = zstandard.compress(_planes(number[coded.indices.to_numpy()]), 3)
            fields = [pa.array([at], pa.int64()), pa.array([[len(f) for f in found]], pa.list_(pa.int32())), pa.array([codes], pa.binary()), pa.array([lists], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            return pa.RecordBatch.from_arrays(fields, names=["block", "sizes", "codes", "lists", "rows"])

        for batch in batches:
            row, start = batch.column(0), 0
            for i, content in enumerate(batch.column(1)):
                found.append(pa.array(split(content.as_py() or ""), pa.string()))
                n += len(found[-1])
                if n >= size or i + 1 == len(row):
                    held.append(row.slice(start, i + 1 - start))
                    start = i + 1
                if n >= size:
                    yield block()
                    at, found, held, n = at + 1, [], [], 0
        if held:
            yield block()

    return bucketed(rows.mapInArrow(run, schema), "block", shards // SHARDS)


def _encoded_lists(blocks: DataFrame, ranks: Broadcast, shards: int) -> DataFrame:
    """`block`, `shard` and `ids`: the packed ids of the list's pre-tokens. A shard's lists meet in one task, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = {}, None
        for batch in batches:
            made = []
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if shard != of:
                    known, of = {}, shard
                lengths, data = _unpack(packed)
                ends = np.cumsum(lengths).tolist()
                words = [bytes(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                for w in words:
                    if w not in known:
                        known[w] = merged(w, ranks.value)
                ids = [known[w] for w in words]
                made.append(_pack(np.fromiter(map(len, ids), np.uint32, len(ids)), _planes(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("shard"), pa.array(made, pa.binary())], names=["block", "shard", "ids"])

    lists = blocks.select("block", F.posexplode("lists").alias("shard", "words")).where("words IS NOT NULL")
    return lists.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "block long, shard int, ids binary")


def _encoded(docs: DataFrame, path: str, pattern: str, text: str, keep: list[str] | None, packed: bool, block: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(_with_row(docs, text, keep), pattern, block, shards)
    lists = _encoded_lists(blocks, spark.sparkContext.broadcast(ranks_of(path)), shards)
    back = lists.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "ids"))).alias("lists"))
    found = blocks.select("block", "sizes", "codes", "rows").join(back, "block", "left").select("sizes", "codes", "rows", "lists.ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sizes, codes, rows, lists = (batch.column(k)[i] for k in range(4))
                parts = [_unpack(x) for x in lists.as_py() or []]
                lengths = np.concatenate([np.empty(0, np.uint32), *[n for n, _ in parts]]).astype(np.int64)
                ids = np.concatenate([np.empty(0, np.uint32), *[_whole(x) for _, x in parts]])
                at = _whole(zstandard.decompress(codes.as_py()))
                n = lengths[at]
                total = np.concatenate(([0], np.cumsum(n)))
                place = np.repeat(((np.cumsum(lengths) - lengths)[at] - total[:-1]).astype(np.int32), n)
                place += np.arange(total[-1], dtype=np.int32)
                own = ids[place]
                ends = total[np.concatenate(([0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)))]
                if packed:
                    made = pa.array([own[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                else:
                    made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.values, made], names=["row", "ids"])

    return found.mapInArrow(run, StructType([StructField("row", blocks.schema["rows"].dataType.elementType), StructField("ids", BinaryType() if packed else ArrayType(IntegerType()))])), blocks


def _with_row(df: DataFrame, content: str, keep: list[str] | None) -> DataFrame:
    names = [c for c in df.columns if c != content] if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(row.alias("row"), F.col(f"`{content}`").alias("content"))


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None, packed: bool = False, block: int = BLOCK) -> DataFrame:
    """`row` (the columns `keep`, by default all but the text) and `ids`, by the ranks in `path`; special tokens are ordinary text.

    `packed` ids are bytes, 32 bits a number, the low byte first.
    """
    return _encoded(docs, path, pattern, text, keep, packed, block)[0]


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns `keep`, by default all but the ids) and `bytes`; ids are an array or packed."""
    given = _with_row(tokens, ids, keep)
    table = tokens.sparkSession.sparkContext.broadcast({i: token for token, i in ranks_of(path).items()})
    packed = isinstance(given.schema["content"].dataType, BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = table.value.__getitem__
        for batch in batches:
            lists = batch.column(1).to_pylist()
            made = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist() if packed else x or [])) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["row", "bytes"])

    return given.mapInArrow(run, StructType([StructField("row", given.schema["row"].dataType), StructField("bytes", BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str]) -> DataFrame:
    """Columns `keep`, `n_tokens`, the digest `ids_sha256` of the ids, and the `bytes` they decode to."""
    encoded = encode(docs, path, pattern, text=text, keep=keep, packed=True)
    digested = encoded.select("row.*", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(digested, path).select("row.*", "bytes")

"""Merkle manifests: a digest of each row, trees of eight over the rows of each group, and a proof for every row.

Rows are sorted by range over the cluster (group, order, digest) and packed where they lie into segments of at most 8^5
leaves. Counts of the segments, summed up per group, give each its place among the group's leaves. A segment builds the
subtrees that it holds whole; the few nodes at its ragged ends are shuffled by the coordinate of an ancestor six levels
up and finished there, level by level and six levels a round, up to the group's subroot. The subroots are the leaves of one
more tree of the same kind, whose root stands for all. Proofs come down the same way: from the root to each segment's
topmost nodes by joins of few rows, and from these to the leaves inside the segment.

Digests are SHA-256 in hex; a parent's is that of its children's hex digits, left to right. A last run of fewer than
eight, even of one, has a parent too, until a single node remains.

Defined cases: a null value is a dash in a leaf, so it differs from an empty one; a null group is a group of its own,
first in order; null ids come first in their group; rows of one id are ordered by digest, and
repeated rows are leaves each, with proofs of their own; a long text is hashed whole; an empty table gives an empty
result without a root; columns of the input may come along in `row`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import discard, materialize

#: Children of a node.
FAN = 8
#: Levels of the largest subtree in a segment, and levels that one round finishes.
SEGMENT_LEVELS, STEP = 5, 6
#: Rows of a batch that carries proofs.
PROOFS = 1024
PROOF = "array<struct<position int, siblings array<string>>>"
_ARROW_PROOF = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value its length in bytes, a colon and itself, or a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: p["siblings"])), ""), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to; it is the tree's only if the leaf is one of its own, at its place."""

    def up(below: Column, p: Column) -> Column:
        left, right = F.slice(p["siblings"], F.lit(1), p["position"]), F.slice(p["siblings"], p["position"] + 1, F.size(p["siblings"]))
        return F.sha2(F.concat(F.array_join(left, ""), below, F.array_join(right, "")), 256)

    return F.aggregate(proof, digest, up)


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _count(total: int, level: int) -> int:
    """Nodes of a level above `total` leaves."""
    return -(-total // FAN**level)


def subtrees(digests: list[str], start: int, total: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int]]]:
    """What leaves `start` and following of `total` make up by themselves.

    Returns each level's first place and nodes, and the place (level, index) of nodes that have no parent among them.
    """
    levels, tops = [], []
    first, nodes, level = start, digests, 0
    while nodes:
        levels.append((first, nodes))
        n, end = _count(total, level), first + len(nodes)
        if n == 1:
            tops.append((level, first))
            break
        begin = min(end, first + -first % FAN)
        stop = end if end == n else max(begin, end - end % FAN)
        tops += [(level, i) for i in (*range(first, begin), *range(stop, end))]
        nodes = [_parent(nodes[i - first : i - first + FAN]) for i in range(begin, stop, FAN)]
        first, level = begin // FAN, level + 1
    return levels, tops


def _segments(nodes: DataFrame, order: list[str], levels: int) -> DataFrame:
    """Sorted and packed: `part`, `seq`, `grp`, `n`, `digests` and `rows`."""
    schema = StructType.fromDDL("part long, seq int, grp string, n long, digests array<string>").add("rows", ArrayType(nodes.schema["row"].dataType))
    most = FAN**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        group, digests, rows, n = None, [], [], 0

        def segment() -> pa.RecordBatch:
            own = pa.concat_arrays(rows)
            edge = pa.array([0, n], pa.int32())
            fields = [pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([group], pa.string()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(edge, pa.concat_arrays(digests)), pa.ListArray.from_arrays(edge, own)]
            return pa.RecordBatch.from_arrays(fields, names=["part", "seq", "grp", "n", "digests", "rows"])

        for batch in batches:
            groups, at = batch.column(0).to_pylist(), 0
            while at < len(groups):
                if n and (groups[at] != group or n == most):
                    yield segment()
                    digests, rows, n, seq = [], [], 0, seq + 1
                group, end = groups[at], at
                while end < len(groups) and groups[end] == group and n + end - at < most:
                    end += 1
                digests.append(batch.column(1).slice(at, end - at))
                rows.append(batch.column(2).slice(at, end - at))
                n, at = n + end - at, end
        if n:
            yield segment()

    by = ["grp", *order, "digest"]
    spread = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(spread.select("grp", "digest", "row").mapInArrow(run, schema))


def _placed(segments: DataFrame) -> DataFrame:
    """Segments with the index of their first leaf in its group, and the group's number of leaves."""
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    counts = segments.select("part", "seq", "grp", "n").select("part", "seq", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(group).alias("total"))
    return segments.join(counts, ["part", "seq"])


def _ragged(placed: DataFrame) -> DataFrame:
    """The nodes of segments that have no parent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels, tops = subtrees(r["digests"], r["start"], r["total"])
                rows = [{"grp": r["grp"], "total": r["total"], "level": at, "idx": i, "digest": levels[at][1][i - levels[at][0]], "part": r["part"], "seq": r["seq"]} for at, i in tops]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("part", pa.int64()), ("seq", pa.int32())])
    return placed.select("part", "seq", "grp", "digests", "start", "total").mapInArrow(run, "grp string, total long, level int, idx long, digest string, part long, seq int")


def _round(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """Nodes of levels from `low` with their `path` to level `high` or to the subroot; those of level `high` are added.

    Nodes meet by the ancestor that they have, or would have, at level `high`: at most 8^6 of them.
    """
    kind = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("part", pa.int64()), ("seq", pa.int32()), ("path", _ARROW_PROOF), ("above", pa.int64()), ("subroot", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        group, total = rows[0]["grp"], rows[0]["total"]
        held: dict[int, dict[int, str]] = {at: {} for at in range(low, high + 1)}
        for r in rows:
            held[r["level"]][r["idx"]] = r["digest"]
        runs: dict[tuple[int, int], list[str]] = {}
        for at in range(low, high):
            n = _count(total, at)
            if n == 1:
                break
            for i in {i // FAN for i in held[at]}:
                runs[at, i] = [held[at][k] for k in range(FAN * i, min(n, FAN * (i + 1)))]
                held[at + 1][i] = _parent(runs[at, i])
        out = []
        for r in rows:
            at, i, path = r["level"], r["idx"], []
            while (at, i // FAN) in runs:
                own = runs[at, i // FAN]
                path.append({"position": i % FAN, "siblings": own[: i % FAN] + own[i % FAN + 1 :]})
                at, i = at + 1, i // FAN
            done = _count(total, at) == 1
            out.append(r | {"path": path, "above": None if done else i, "subroot": held[at][i] if done else None})
        if _count(total, high) > 1:
            out += [{"grp": group, "total": total, "level": high, "idx": i, "digest": digest} for i, digest in held[high].items()]
        return pa.Table.from_pylist(out, schema=kind)

    schema = f"grp string, total long, level int, idx long, digest string, part long, seq int, path {PROOF}, above long, subroot string"
    ancestor = F.expr(f"shiftright(idx, 3 * ({high} - level))")
    return nodes.groupBy("grp", ancestor.alias("ancestor")).applyInArrow(run, schema)


def _paths(nodes: DataFrame, step: int) -> DataFrame:
    """Of each segment's ragged nodes the whole `path` up to their group's `subroot`."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    rounds, low = [], 0
    while True:
        made = materialize(_round(nodes, low, low + step))
        rounds.append((low + step, made))
        if _count(most, low + step) == 1:
            break
        low += step
        nodes = made.where(F.col("level") == low).select(nodes.columns)
    found = None
    for high, made in reversed(rounds):
        own = made.where(F.col("level") < high)
        if found is not None:
            above = found.select("grp", F.col("idx").alias("above"), F.col("path").alias("more"), F.col("subroot").alias("reached"))
            own = own.join(above, ["grp", "above"], "left").withColumns({"path": F.concat("path", F.coalesce("more", F.array().cast(PROOF))), "subroot": F.coalesce("subroot", "reached")})
        found = own.select("grp", "level", "idx", "part", "seq", "path", "subroot")
    return found.where("part IS NOT NULL")


def _proved(placed: DataFrame, tops: DataFrame) -> DataFrame:
    """`row`, `leaf`, `subroot`, `root` and `proof` of every leaf, from the paths of its segment's topmost nodes."""
    names = ["row", "leaf", "subroot", "root", "proof"]
    above = tops.groupBy("part", "seq").agg(F.collect_list(F.struct("level", "idx", "path")).alias("tops"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))
    found = placed.join(above, ["part", "seq"]).select("digests", "start", "total", "tops", "subroot", "root", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                digests, start, total, tops, subroot, root = (batch.column(c)[k].as_py() for c in range(6))
                rows = batch.column(6)[k].values
                levels, _ = subtrees(digests, start, total)
                upper = {(t["level"], t["idx"]): t["path"] for t in tops}
                for a in range(0, len(digests), PROOFS):
                    proofs = []
                    for i in range(start + a, start + min(a + PROOFS, len(digests))):
                        path, at = [], 0
                        while (at, i) not in upper:
                            first, nodes = levels[at]
                            own = nodes[i - i % FAN - first : i - i % FAN - first + FAN]
                            path.append({"position": i % FAN, "siblings": own[: i % FAN] + own[i % FAN + 1 :]})
                            at, i = at + 1, i // FAN
                        proofs.append(path + upper[at, i])
                    n = len(proofs)
                    yield pa.RecordBatch.from_arrays([rows.slice(a, n), pa.array(digests[a : a + n], pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, _ARROW_PROOF)], names=names)

    schema = StructType().add("row", placed.schema["rows"].dataType.elementType)
    return found.mapInArrow(run, StructType([*schema, *StructType.fromDDL(f"leaf string, subroot string, root string, proof {PROOF}")]))


def manifest(rows: DataFrame, columns: list[str], *, group: str, order: str, keep: list[str] | None = None, segment_levels: int = SEGMENT_LEVELS, step: int = STEP) -> DataFrame:
    """`row` (the columns `keep`, by default all), `leaf`, `subroot`, `root` and `proof` of every row.

    A proof has for each level from the leaf to the root the node's `position` in its run, and its `siblings`.
    """
    if segment_levels >= step:
        raise ValueError("a round must finish more levels than a segment has")
    key = F.when(F.col(f"`{group}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")))
    leaves = materialize(rows.select(key.alias("grp"), F.col(f"`{order}`").alias("place"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in keep or rows.columns]).alias("row")))
    placed = _placed(_segments(leaves, ["place"], segment_levels))
    discard(leaves)
    ragged = materialize(_ragged(placed))
    tops = _paths(ragged, step)
    groups = materialize(tops.groupBy("grp").agg(F.first("subroot").alias("digest")))
    every = _placed(_segments(groups.select(F.lit("").alias("grp"), F.col("grp").alias("place"), "digest", F.struct("grp").alias("row")), ["place"], segment_levels))
    last = _paths(materialize(_ragged(every)), step)
    upper = _proved(every, last.withColumn("root", F.col("subroot"))).select("row.grp", "root", F.col("proof").alias("more"))
    tops = tops.join(upper, "grp").withColumn("path", F.concat("path", "more"))
    return _proved(placed, tops)

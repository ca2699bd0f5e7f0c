"""Merkle manifests against a plain version and against SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from motecraft.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and the siblings of each leaf on its way up, each with its place."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            own = runs[i // 8]
            paths[k].append((i % 8, own[: i % 8] + own[i % 8 + 1 :]))
        at, nodes = [i // 8 for i in at], [h("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[c] for c in COLUMNS]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = tree([built[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1], strict=True):
            full, digest = path + above, leaf
            if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 0:
                digest = leaf_of([None if r[c] is None else r[c].translate({i: i + 32 for i in range(65, 91)}) if c == "text" else r[c] for c in COLUMNS])
            for place, others in full:
                digest = h("".join([*others[:place], digest, *others[place:]]))
            out.append((r["doc_id"], leaf, built[g][0], root, h("".join(x for _, others in full for x in others)), digest, digest == root))
    return Counter(out)


def test_subtrees_of_any_cut_make_the_same_tree():
    rng = random.Random(3)
    for total in (1, 2, 7, 8, 9, 63, 64, 65, 100, 520):
        leaves = [h(str(i)) for i in range(total)]
        want = {}
        for level, (first, nodes) in enumerate(merkle.subtrees(leaves, 0, total)[0]):
            want |= {(level, first + k): n for k, n in enumerate(nodes)}
        assert want[max(want)] == tree(leaves)[0]
        cuts = sorted({0, total, *(rng.randrange(total + 1) for _ in range(5))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            levels, tops = merkle.subtrees(leaves[a:b], a, total)
            assert all(want[level, first + k] == n for level, (first, nodes) in enumerate(levels) for k, n in enumerate(nodes))
            assert len(tops) == len(set(tops)) and all(t in want for t in tops)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, i % 150, i]), rng.choice(["A B", "é B", None, "", "x" * 40_000]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, "s"]), rng.choice([None, 3, -1])) for i in range(700)]
    rows += rows[:40]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in ("row", "grp", "leaf", "digest", "proof", "root", "part", "seq", "n", "place")}).repartition(5)


def test_odd_rows_small_segments_and_several_rounds(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(odd.collect())
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == want
    made = merkle.manifest(odd, COLUMNS, group="lang", order="doc_id", segment_levels=1, step=2)
    folded = made.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), merkle.folded(F.col("leaf"), F.col("proof")).alias("f"))
    assert Counter(tuple(r)[:5] for r in folded.collect()) == Counter({k: 0 for k in want}) | Counter([k[:5] for k in want.elements()])
    assert folded.where("f <> root").count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, lang string"), ["doc_id"], group="lang", order="doc_id").collect() == []


def test_query_equals_sql_and_plain(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = queries.op12_merkle_manifest(spark, sf)
    got = Counter(map(tuple, found.collect()))
    want = con.sql(queries.ORACLES["op12_merkle_manifest"])
    assert want.columns == found.columns
    assert got == Counter(want.fetchall()) == plain(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {v for *_, v in got} == {True, False}

"""Merkle manifest against a plain recursive version."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siteloom.llm import merkle, q_merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """Root of a list of hashes, and per leaf the (left, right) siblings of each level."""
    at, paths = list(range(len(leaves))), [[] for _ in leaves]
    while len(leaves) > 1:
        runs = [leaves[i:i + fanout] for i in range(0, len(leaves), fanout)]
        for i, place in enumerate(at):
            run, slot = runs[place // fanout], place % fanout
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[i] = place // fanout
        leaves = [h("".join(run)) for run in runs]
    return leaves[0], paths


def brute(rows, fanout=3):
    """Sorted result rows for (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append(tree([leaf(r) for r in groups[s]], fanout))
    root, tops = tree([sub for sub, _ in subs], fanout)
    out = []
    for s, (sub, paths), top in zip(order, subs, tops):
        for row, path in zip(groups[s], paths):
            altered = list(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                altered[4] = row[4].replace("\n", "")
            f = leaf(altered)
            for left, right in path + top:
                f = h(left + f + right)
            out.append((row[0], leaf(row), sub, root, h("".join(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, pos string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], SCHEMA)


def run(docs, monkeypatch, fanout=3):
    monkeypatch.setattr(q_merkle, "table", lambda *_: docs)
    return sorted((tuple(r) for r in q_merkle.op13(None, "").collect()), key=str)


AWKWARD = [
    (1, "a", "en", 5, "one\ntwo"), (2, "a", None, None, None), (3, "a", "", 0, ""), (4, None, "de", 2, "é\n🙂"), (4, None, "de", 2, "é\n🙂"),
    (4, None, "de", 3, "other"), (None, "b", "en", 1, "x\ny"), (None, None, None, None, None), (7, "Z", "en", 3, "long\n" * 60000), (8, "é", "fr", 1, "\n"),
    (-5, "a", "en", 1, "\n\n"), (10 ** 15, "", "en", 1, "empty source\n"),
]


def test_awkward_rows(spark, monkeypatch):
    assert run(frame(spark, AWKWARD), monkeypatch) == brute(AWKWARD)


@pytest.mark.parametrize("block", [4, 1000])
def test_several_rounds_and_a_hot_source(spark, monkeypatch, block):
    """Blocks of 3 or 729 leaves; one source holds most rows."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(i, "hot" if i % 5 else f"s{i % 7}", "en", i, f"text\n{i}") for i in range(1, 800)]
    got = run(frame(spark, rows), monkeypatch)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, monkeypatch, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert run(frame(spark, rows), monkeypatch) == brute(rows)


def test_empty_table(spark, monkeypatch):
    assert run(frame(spark, AWKWARD).limit(0), monkeypatch) == []


def test_own_fields_and_fanout(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", f"v{i}") for i in range(20)], "k int, g string, v string")
    out = merkle.manifest(df, "k", "g", ("k", "v"), fanout=2).withColumn("folded", merkle.fold(F.col("leaf"), F.col("siblings"))).collect()
    groups = {f"g{j}": [h("".join(f"{len(x)}:{x}" for x in (str(i), f"v{i}"))) for i in range(20) if i % 3 == j] for j in range(3)}
    root, _ = tree([tree(leaves, 2)[0] for leaves in groups.values()], 2)
    assert {r.root for r in out} == {root} and all(r.folded == root for r in out)
    assert all(r.subroot == tree(groups[r.grp], 2)[0] for r in out)
    with pytest.raises(ValueError):
        merkle.manifest(df, "k", "g", ("k",), fanout=1)

"""Near-duplicate components against all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from siteloom.llm import graph, minhash


def brute(rows, k, num, den):
    """Component of each row by comparing all sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_awkward_rows(docs, k, num):
    got = minhash.near_duplicates(docs, k, num, 100).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], k, num, 100)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert len(got) == docs.count()
    unnamed, = [r for r in got if r.doc_id is None]
    assert unnamed.component_id == 15 and unnamed.kept is False


def test_near_copies_of_one_text(spark):
    """A group in which only some pairs are links: copies of one text with 0 to 14 words changed."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        for j in range(i % 15):
            w[(i * 31 + j * 17) % 120] = f"v{(i + j) % 4}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85, 100).collect()} == {i: c for i, (_, c) in want.items()}


def test_empty_table(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_windows_are_shifts_of_one_permutation():
    import numpy as np

    scatter, ring = minhash.permutations()
    assert len(np.unique(scatter)) == len(scatter) == minhash.UNIVERSE
    assert (ring[5][1:] == ring[6][:-1]).all() and ring[minhash.UNIVERSE - 1][1] == ring[0][0]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.component for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}
    assert graph.components(df.where(F.lit(False))).count() == 0


def test_words_of_two_letters_are_told_apart(spark):
    """Words on which sums of powers modulo 2**64 collide are two sets."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_one_id_with_two_texts(spark):
    """Its texts are linked through it; rows repeated and near copies among them."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two), (4, three), (4, three), (5, three + " end"), (6, "its own words here")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    assert {(r.doc_id, r.kept) for r in got} == {(1, True), (2, False), (3, False), (4, True), (5, False), (6, True)}


def test_rounds_of_components_write_few_files(spark, tmp_path, monkeypatch):
    """A file for each shuffle partition and round made executors start thousands of processes."""
    monkeypatch.setattr("siteloom.session.scratch_dir", lambda _: str(tmp_path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = graph.components(spark.createDataFrame([(i, i + 1) for i in range(0, 900, 3)], "a long, b long"))
        assert {(r.v, r.component) for r in found.collect()} == {(v, v - v % 3) for i in range(0, 900, 3) for v in (i, i + 1)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    tables = {p.parent for p in tmp_path.rglob("part-*.parquet")}
    assert tables and all(len(list(t.glob("part-*.parquet"))) <= spark.sparkContext.defaultParallelism for t in tables)


def test_tables_of_links_are_few_files(spark, tmp_path, monkeypatch):
    """Buckets, pivots, prefixes and pairs too, with the same links."""
    monkeypatch.setattr("siteloom.session.scratch_dir", lambda _: str(tmp_path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*base[:n], f"own{n}", f"more{n}", *base[n:]])) for n in range(0, 60, 2)] + [(100 + n, f"alone {n} " * 4) for n in range(9)]
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85, 100).items()}
    files = {t: len(list(t.glob("part-*.parquet"))) for t in {p.parent for p in tmp_path.rglob("part-*.parquet")} if t.name in ("buckets", "pivots", "prefixes", "pairs")}
    assert {"buckets", "pivots"} <= {t.name for t in files}
    assert all(n <= spark.sparkContext.defaultParallelism for n in files.values())

"""Whitened embeddings against numpy and whole-number arithmetic."""

import math

import numpy as np
import pytest

from siteloom.llm import q_whitening, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, index long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 5) for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """{(id, component): (n, deviation, |whitened|, explained)} in plain numpy."""
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in good]
    fit = sorted(set(x for _, x in xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda x: np.array([(n * a - b) / n for a, b in zip(x, s)])
    y = np.array([centre(x) for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in xs:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        for c in range(min(most, len(s))):
            w = abs(float(centre(x) @ u[:, c])) / math.sqrt(e[c])
            out.append((i, c + 1, n, dev, w, float(e[c] / np.trace(v))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def run(df, monkeypatch):
    monkeypatch.setattr(q_whitening, "table", lambda *_: df)
    got = q_whitening.op11(None, "").collect()
    return sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component, r.deviation or 0))


def test_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 20 * 30)
    monkeypatch.setattr(whitening, "RUN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21) / 5 + 100).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(7, rows[8][1]), (None, rows[9][1])]
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * 19), (2003, [math.nan] + [1.0] * 19), (2004, [math.inf] * 20), (2005, [1.0] * 19), (2006, [3e38] * 20)]
    got, want = run(frame(spark, rows + bad), monkeypatch), brute(rows)
    assert len(got) == len(want) == 16 * 602
    for r, w in zip(got, want):
        assert (r.vec_id, r.component, r.n, r.deviation) == w[:4]
        assert abs(abs(r.whitened) - w[4]) < 1e-6 and abs(r.explained / w[5] - 1) < 1e-9
        assert r.identity_error < 1e-9
    # One sign per component: copies agree, and correlations keep theirs.
    first = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id is not None and r.vec_id != 7}
    assert all(first[1000, c] == first[1199, c] for c in range(1, 17))


def test_degenerate(spark, monkeypatch):
    same = run(frame(spark, [(i, [1.0, 2.0]) for i in range(5)]), monkeypatch)
    assert len(same) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = run(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]), monkeypatch)
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert all(r.identity_error < 1e-9 for r in line)
    assert run(frame(spark, [(1, None), (2, [])]), monkeypatch) == []
    assert run(frame(spark, [(1, None)]).limit(0), monkeypatch) == []


def test_large_entries_are_exact(spark, monkeypatch):
    rows = [(i, [float((i * 7919) % 97) * 2.0 ** 38, 1.0 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, model = whitening.whiten(df)
    xs = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*xs)]
    assert model.sums == s
    assert {r.id: r.deviation for r in out.collect()} == {i: sum((40 * a - b) ** 2 for a, b in zip(x, s)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("table", ["sf0.001"])
def test_given_table(spark, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    got = q_whitening.op11(spark, f"/root/testdata/{table}").collect()
    want = brute([(r.vec_id, list(r.embedding)) for r in rows.collect()])
    got.sort(key=lambda r: (r.vec_id, r.component))
    assert len(got) == len(want)
    assert all((g.vec_id, g.component, g.n, g.deviation) == w[:4] and abs(abs(g.whitened) - w[4]) < 1e-6 for g, w in zip(got, want))

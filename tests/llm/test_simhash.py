"""SimHash components against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from siteloom.llm import q_simhash, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mark(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    runs = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=2, k=3):
    """(doc_id, fingerprint, component) of each row; rows of one id are one document."""
    marks = [(i, mark(t, k)) for i, t in rows]
    up = list(range(len(marks)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(marks):
        for y, (j, b) in enumerate(marks[:x]):
            if (a ^ b).bit_count() <= distance or (i is not None and i == j):
                up[root(x)] = root(y)
    name = {}
    for x, (i, _) in enumerate(marks):
        if i is not None:
            name[root(x)] = min(i, name.get(root(x), i))
    return sorted(((i, a, name.get(root(x))) for x, (i, a) in enumerate(marks)), key=str)


def got(df, distance=2):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, 3, distance).collect()), key=str)


@pytest.mark.parametrize("distance", [0, 2])
def test_awkward_rows(docs, distance):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(docs, distance)
    assert found == brute(rows, distance)
    zero = {c for _, f, c in found if f == 0}
    assert len(zero) == 1


@pytest.mark.parametrize("homes", [1, 512])
def test_near_copies(spark, monkeypatch, homes):
    """Copies of one text with a few words changed, and texts of their own; crowded anchors or not."""
    monkeypatch.setattr(simhash, "HOMES", homes)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(20))) for i in range(1000, 1040)]
    for i in range(160):
        w = list(words)
        for j in range(i % 4):
            w[(i * 31 + j * 17) % 500] = f"v{(i + j) % 5}"
        rows.append((i, " ".join(w)))
    rows += [(7, "another text under an id in use"), (None, rows[50][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    # Far fewer components than fingerprints.
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) - 40
    assert got(df) == want


def test_empty_table_and_wrong_distance(docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, distance=3)


def test_code_covers_and_copies_reach():
    """Every word has one home within the radius, and the home of x is among the copies of all y within two bits."""
    octet, tiers = simhash.code(2)
    assert (tiers[0][2] == 1).all() and len(tiers[0][0]) == 2048
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(1 << int(a)) | np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    y = (x ^ np.array(flips, np.uint64)).view(np.int64)
    home, far, row = simhash.anchors_of(x.view(np.int64), 2, home=True)
    assert not far.any() and (row == np.arange(300)).all()
    anchor, far, row = simhash.anchors_of(y, 2)
    reach = [set(anchor[row == i].tolist()) for i in range(300)]
    assert all(int(home[i]) in reach[i] for i in range(300))
    assert (~far).sum() == 300 and 55 < len(anchor) / 300 < 68
    for i, a in zip(row.tolist(), anchor.tolist()):
        d = [bin((int(y[i]) ^ a) >> s & simhash.HALF).count("1") for s in (0, 23)]
        assert sum(max(0, v - 3) for v in d) <= 2


def test_query_digits(docs, monkeypatch):
    monkeypatch.setattr(q_simhash, "table", lambda *_: docs)
    for r in q_simhash.op12(None, "").collect():
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint)
    assert {r.fingerprint for r in q_simhash.op12(None, "").where("doc_id IN (5, 6, 7)").collect()} == {"0" * 16}

"""Removed bytes against a set of all windows; maximal repeats against all pairs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.llm import repeats


def brute(rows):
    """Covered bytes of each (id, text) in order of ids."""
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone, fresh = bytearray(len(b)), []
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        out[i] = gone
    return out


def digest(text, gone):
    b = (text or "").encode()
    runs = sum(gone[x] and (x == 0 or not gone[x - 1]) for x in range(len(b)))
    return len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def check(df):
    rows = sorted({(r.doc_id, r.text) for r in df.collect()}, key=lambda r: r[0])
    want = brute(rows)
    texts = dict(rows)
    got = repeats.digests(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == digest(texts[r.doc_id], want[r.doc_id]), r.doc_id


def test_awkward_rows(docs):
    check(docs.where("doc_id IS NOT NULL"))


def test_null_ids_and_ids_with_two_texts(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(None, text), (1, text), (1, "z" + text), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.digests(df).collect()}
    assert got[(None, 300)] == 300 and got[(2, 0)] == 0
    assert got[(1, 300)] + got[(1, 301)] == 300


@pytest.mark.parametrize("seed", range(3))
def test_random_mosaics(spark, seed):
    """Texts glued from shared blocks, periodic runs and noise, with small changes."""
    rnd = random.Random(seed)
    blocks = ["".join(rnd.choice("abcdef ghij") for _ in range(rnd.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(blocks) if rnd.random() < 0.7 else rnd.choice(["ab", "é", "xyz-", "q"]) * rnd.randint(1, 150)
            if rnd.random() < 0.3:
                p = p[:len(p) // 2] + "#" + p[len(p) // 2:]
            parts.append(p)
        rows.append((i, "".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_hot_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    rnd = random.Random(9)
    shared = "".join(rnd.choice("abcdefgh") for _ in range(250))
    rows = [(i, f"{rnd.random()}" * 3 + shared + f"{rnd.random()}" * 4) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_maximal_repeats_have_all_occurrences():
    rnd = random.Random(4)
    core = "".join(rnd.choice("abcd") for _ in range(130))
    texts = [f"1{core}x", f"2{core}y", f"3{core[:110]}z", f"4{core}x"]
    data = [t.encode() for t in texts]
    raw, at = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = {}
    for which, length, doc, start in repeats.occurrences(raw, at, np.arange(4), np.zeros(4, np.int64)):
        for w, n, d, s in zip(which, length, doc, start):
            found.setdefault((w, n), set()).add((int(d), int(s)))
    got = {(texts[min(v)[0]][min(v)[1]:min(v)[1] + n], frozenset(v)) for (_, n), v in found.items()}
    assert got == {
        (core[:110], frozenset({(0, 1), (1, 1), (2, 1), (3, 1)})), (core, frozenset({(0, 1), (1, 1), (3, 1)})),
        (core + "x", frozenset({(0, 1), (3, 1)}))}


def test_texts_keep_whole_characters(docs):
    kept = {r.doc_id: r.text for r in repeats.drop_repeats(docs.where("doc_id IN (1, 2, 6, 17)")).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert kept[1] == before[1] and kept[2] == "" and kept[6] is None
    assert kept[17] in before[17] and 0 < len(kept[17]) < len(before[17])


def test_empty_table_and_columns(docs):
    empty = docs.where(F.lit(False))
    assert repeats.digests(empty).count() == 0
    assert repeats.drop_repeats(docs).columns == docs.columns


def test_memory_of_a_worker_follows_its_chunks(monkeypatch):
    import tracemalloc

    from siteloom.llm import common

    monkeypatch.setattr(common, "_POW", {})
    up, down = common.powers(1000)
    assert 1000 <= len(up) == len(down) <= 2048
    assert len(common.powers(5000)[0]) >= 5000 and len(common.powers(common.CHUNK_BYTES)[0]) == common.CHUNK_BYTES + 1
    batch = pa.RecordBatch.from_pydict({"text": ["".join(chr(97 + (i * j * j) % 23) for j in range(1000)) for i in range(1500)]})
    tracemalloc.start()
    for _, _, raw, at in common.chunks(batch, "text", repeats.CUT_BYTES):
        repeats.anchors(raw, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20

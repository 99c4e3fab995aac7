"""Sharding, URL filter, WARC, licences, neighbours, quality and the pipeline on small data."""

import base64
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import forest, license_scan, quality, sharding, urls, warc
from siteloom.llm.q_url import RULES
from siteloom.session import new_path

SF = "/root/testdata/sf0.001"


# ---- sharding ------------------------------------------------------------------
def test_shards_keep_their_limit(spark, docs):
    rows = sharding.assign(docs, 6000).collect()
    assert len(rows) == docs.count()
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
        bits = r.shard.split("+")[0]
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert format(key, "060b").startswith(bits)
    assert all(n <= 6000 or n == max(r.n_bytes for r in rows if r.shard == s) for s, n in total.items())
    assert all(r.shard_bytes == total[r.shard] for r in rows)


def test_a_key_with_many_rows_is_counted_off(spark):
    df = spark.range(90).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text")).repartition(4)
    rows = sharding.assign(df, 100).collect()
    assert len(rows) == 90 and len({r.shard for r in rows}) == 9 and {r.shard_bytes for r in rows} == {100}
    assert sharding.assign(df.limit(0), 100).count() == 0


# ---- URL filter ------------------------------------------------------------------
def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].lower(), m[2]
    best = None
    for verb, rule in RULES:
        site, _, tail = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verb, rule)
    return host, path, best


def plain_ratio(train, asked, order):
    """Witten-Bell from the uniform distribution up, in dictionaries."""
    from collections import Counter
    from math import log

    models = {}
    for good in (True, False):
        runs = Counter()
        for url, label in train:
            if label == good:
                s = "^" + url
                for e in range(1, len(s)):
                    for k in range(1, order + 1):
                        if e + 1 - k >= 0:
                            runs[s[e + 1 - k:e + 1]] += 1
        models[good] = runs

    def p(runs, s, e):
        out = 1 / urls.ALPHABET
        for k in range(1, min(order, e + 1) + 1):
            context = s[e + 1 - k:e]
            after = [n for r, n in runs.items() if len(r) == k and r[:-1] == context]
            if after:
                out = (runs[s[e + 1 - k:e + 1]] + len(after) * out) / (sum(after) + len(after))
        return out

    return {u: sum(log(p(models[True], "^" + u, e) / p(models[False], "^" + u, e)) for e in range(1, len(u) + 1)) / len(u) for u in asked}


def test_urls_against_plain_rules_and_models(spark):
    hosts = ["a.com", "www.example.com", "example.com", "x.net", "b.org", "EXAMPLE.com:80"]
    texts = [f"http://{h}/{p}{i}" for i in range(6) for h in hosts for p in ("en/", "fr/", "es/q?x=", "")] + ["", None, "no scheme", "http://b.org", "x://a.com"]
    df = spark.createDataFrame(list(enumerate(texts + texts[:3])), "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in urls.judge(df, RULES).collect()}
    assert len(rows) == len(texts) + 3
    folds = {r.page_id: r.f for r in df.select("page_id", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)).alias("f")).collect()}
    ruled = {i: plain_rule(u) for i, u in enumerate(texts + texts[:3])}
    train = [(u, ruled[i][2][0] == "allow") for i, u in enumerate(texts + texts[:3]) if ruled[i][2] and folds[i] > 0]
    open_ = {i: u for i, u in enumerate(texts) if not ruled[i][2] and u}
    ratio = plain_ratio(train, set(open_.values()), urls.ORDER)
    for i, (host, path, best) in ruled.items():
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        if best:
            assert r.verdict == best[0]
    for i, u in open_.items():
        assert rows[i].llr == pytest.approx(ratio[u], abs=1e-9)
    assert rows[texts.index("")].llr == 0
    # The verdict follows one cut.
    judged = [(rows[i].llr, rows[i].verdict) for i in open_]
    assert max([x for x, v in judged if v == "block"], default=-99) < min([x for x, v in judged if v == "allow"], default=99)


def test_urls_without_training(spark):
    df = spark.createDataFrame([(1, "http://b.org/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df, RULES).collect()} == {"allow"}
    assert urls.judge(df.limit(0), RULES).count() == 0


# ---- WARC ---------------------------------------------------------------------------
PAGES = [(1, "http://b.example/x", "<p>one</p>"), (2, "http://a.example/é", "<p>one</p>"), (3, None, None), (4, "http://b.example/x", ""), (5, "x\ty", "a\r\n\r\nWARC/1.1 b"),
         (6, "http://a.example:81/?q", "ü" * 70000), (2, "http://c.example", "<p>two</p>")]


def test_archives_and_index(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    got = sorted(tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1).collect())
    first = {}
    for p, _, h in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(h or "", p)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(p, len((h or "").encode()), sha(h), "response" if first[h or ""] == p else "revisit", -1 if first[h or ""] == p else first[h or ""]) for p, _, h in PAGES]
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_lookup_reads_only_what_it_needs(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i}", f"<p>{i % 5}</p>") for i in range(60)], "page_id long, url string, html string")
    archives, index = new_path(spark, "warc"), new_path(spark, "index")
    warc.write_archives(df, archives)
    warc.write_index(warc.scan(spark, archives), index)
    directory = spark.read.parquet(f"{index}/directory")
    assert directory.agg(F.sum("lines")).first()[0] == 60 and directory.count() >= 8
    entries = warc.lookup(spark, index, ["http://h3.example/3", "http://h3.example/10", "http://no.example/"])
    assert sorted(r.page_id for r in entries.collect()) == [3, 10]
    pages = {r.page_id: r for r in warc.read_ranges(spark, entries).collect()}
    assert bytes(pages[3].payload) == b"<p>3</p>" and pages[10].record_type == "revisit" and pages[10].refers_to == 0


def test_directory_and_files_keep_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "DIRECTORY_LINES", 8)
    monkeypatch.setattr(warc, "DIRECTORY_KEY", 5)
    monkeypatch.setattr(warc, "FILE_BYTES", 700)
    monkeypatch.setattr(warc, "RUN_BYTES", 500)
    # One hot URL over several blocks, keys that differ behind the cut only, odd addresses, a page over the file bound.
    urls = ["http://hot.example/"] * 30 + [f"http://hot.example/{i}" for i in range(20)] + [None, "", "a\tb\nc", "http://[x", " http://hot.example/7 "]
    rows = [(i, u, "".join(chr(33 + (i * j) % 90) for j in range(40 if i else 5000))) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives, index = new_path(spark, "warc"), new_path(spark, "index")
    warc.write_archives(df, archives)
    entries = warc.scan(spark, archives)
    per_file = {r.file: (r.bytes, r.top) for r in entries.groupBy("file").agg(F.sum("size").alias("bytes"), F.max("size").alias("top")).collect()}
    assert len(per_file) > 5 and all(n <= 700 + top for n, top in per_file.values())
    warc.write_index(entries, index)
    assert 4 <= spark.read.parquet(f"{index}/directory").count() <= 8 + 8
    got = {r.page_id: r for r in warc.read_ranges(spark, warc.lookup(spark, index, df.select("url"))).collect()}
    assert sorted(got) == list(range(len(urls)))
    assert all(got[r.refers_to if r.refers_to is not None else i].payload.decode() == rows[i][2] for i, r in got.items())
    assert sorted(r.page_id for r in warc.lookup(spark, index, ["http://hot.example/"]).collect()) == list(range(30))


def test_directory_search_and_runs():
    first = ["a", "b", "b", "b", "d"]
    assert [list(warc.blocks_of(first, k, 5)) for k in ("A", "a", "b", "c", "e")] == [[], [0], [0, 1, 2, 3], [3], [4]]
    assert list(warc.blocks_of([], "a", 5)) == []
    ranges = [(120, 30), (0, 100), (500, 10)]
    assert list(warc.runs(ranges)) == [(0, 150, [(0, 100), (120, 30)]), (500, 510, [(500, 10)])]


# ---- licences ------------------------------------------------------------------------
def test_license_scan(spark, docs):
    texts = {200: "See the MIT\nLicense. MIT license!", 201: "Licensed undr the Apache Licence, version 2.0", 202: "mitlicense apache  LICENSE", 203: None,
             204: "released under the mit license " * 3, 205: "permission is hereby granted, free of charges, to any persons obtaining a copy of the software"}
    df = docs.unionByName(spark.createDataFrame([(i, t, "e") for i, t in texts.items()], docs.schema)).withColumn("note", F.lit("kept"))
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (rows[200].n_base, rows[200].first_word, rows[200].last_word, rows[200].base_labels, rows[200].score) == (2, 2, 4, "mit", 1.0)
    assert (rows[201].n_base, rows[201].labels) == (0, "apache-2.0") and 0.9 < rows[201].score < 1
    assert [tuple(s)[1:] for s in rows[201].spans] == [(0, 7, 2)]
    assert (rows[202].n_base, rows[202].base_labels, rows[202].labels) == (1, "apache", "apache")
    assert (rows[203].n_words, rows[203].score, rows[203].first_word, rows[203].labels) == (0, 0.0, None, "")
    assert [s.first for s in rows[204].spans] == [0, 5, 10] and rows[205].labels == "mit-notice"
    assert rows[5].note == "kept" and license_scan.scan(df.limit(0)).count() == 0
    for r in docs.collect():
        if r.doc_id is not None:
            low = (r.text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
            assert rows[r.doc_id].n_words == len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_spans_against_edit_distance():
    rng = np.random.default_rng(5)
    notices = [license_scan.Notice(label, text) for label, text in license_scan.NOTICES.items()]
    for notice in notices:
        for edits in range(notice.edits + 1):
            own = bytearray(notice.text)
            for at in rng.choice(np.arange(2, len(own) - 2), edits, replace=False):
                own[at] = ord("q")
            text = b" some words before " + bytes(own) + b" and behind "
            found = notice.find(text)
            assert len(found) == 1 and found[0][2] <= edits
            a, b, n = found[0]
            assert _distance(notice.text, text[a:b]) == n
            first = text.count(b" ", 0, a + 1) - (0 if text[a:a + 1] == b" " else 1)
            assert license_scan.scan_text(text, [notice])[1][0][1] == first


def test_license_scan_is_linear_in_the_places():
    text = b" " + b"mit license " * 100_000
    start = time.process_time()
    base, _, score = license_scan.scan_text(text, [])
    assert time.process_time() - start < 2 and score == 1.0
    assert [w for _, w in base] == list(range(0, 200_000, 2))


# ---- neighbours ----------------------------------------------------------------------
@pytest.mark.parametrize("norms", [False, True])
def test_neighbours(spark, norms):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    vecs = centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 24)) * 0.7
    if norms:
        vecs *= rng.uniform(0.2, 3, (700, 1))
    vecs[40] = vecs[41] = vecs[60]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(900, None), (920, []), (940, [0.0] * 24), (960, [float("nan")] * 24), (980, [1.0] * 3), (1000, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and q not in [x[1] for x in found]
        scores = vecs @ vecs[q]
        assert all(s == pytest.approx(scores[v], rel=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        scores[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.argsort(-scores, kind="stable")[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in forest.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert forest.nearest(df.limit(0), df).count() == 0 and forest.nearest(df, df.limit(0)).count() == 0


# ---- quality --------------------------------------------------------------------------
def test_gradients():
    """The fit lowers the loss on bags that only attention can tell apart."""
    rng = np.random.default_rng(0)
    row_at = np.arange(0, 5 * 300 + 1, 5)
    x = rng.normal(size=(1500, quality.WIDTH))
    y = (np.arange(300) % 2).astype(float)
    x[row_at[:-1][y == 1] + rng.integers(0, 5, 150), 3] += 6
    model = quality.fit(x, row_at, y)
    assert ((model.score(x, row_at) >= 0.5) == y).mean() > 0.95


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).where(quality.held_out("doc_id")).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95


def test_quality_of_awkward_rows(spark, docs):
    rows = quality.score(docs, 0.25).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.25}
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (6, None), (11, 1), (13, 0), (13, 1), (None, 1)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(docs, quality.train(docs, labels)).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.train(docs, labels.limit(0)) == 0.5
    assert quality.score(docs.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        quality.score(docs.withColumn("score", F.lit(1)), 0.5)

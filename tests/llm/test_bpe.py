"""BPE against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteloom.llm import bpe
from siteloom.llm.common import chunks
from siteloom.llm.q_bpe import round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode(encoder, texts):
    import pyarrow as pa

    out = []
    for _, _, raw, at in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t"):
        ids, row = encoder.encode(raw, at)
        out += [ids[a:b].tolist() for a, b in zip(row[:-1], row[1:])]
    return out


ODD = ["", " ", "a<|endoftext|>b<|endoftext|>", "<|endof", "text|>", "it's''s 'S 'sta 're's'll'v we'", "'", "\n's \t're", "  x   y\n\n z ", "\xa0 x", "\x1c\x85",
       "२3²½ⅷ①", "🙂🙂é", "x" * 600, " " * 300, "don'T can't", "ab" * 300]


def test_odd_texts(library):
    assert encode(bpe.Encoder(bpe.load_tables(PATH)), ODD) == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


_ENCODER = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" 'stlm\n\t<|endoftext|>")), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    encoder = _ENCODER.setdefault("e", None) or _ENCODER.update(e=bpe.Encoder(bpe.load_tables(PATH)), t=Tokenizer.from_file(PATH)) or _ENCODER["e"]
    assert encode(encoder, texts) == [e.ids for e in _ENCODER["t"].encode_batch(texts, add_special_tokens=False)]


def test_query_columns(spark, docs, library):
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in round_trip(docs, PATH).fillna(-1).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert round_trip(docs.limit(0), PATH).count() == 0


def test_decoding_skips_unknown_ids_and_mends_bytes(spark):
    df = spark.createDataFrame([(1, [64, 99999, -5, 65]), (2, None), (3, []), (4, [None, 64]), (5, [222])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: "ab", 2: "", 3: "", 4: "a", 5: Tokenizer.from_file(PATH).decode([222], skip_special_tokens=False)}


def test_clashing_columns_are_refused(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), PATH)


def swapped(steps):
    """The word made by doubling "a" with its letters swapped, and the same word with all letters swapped."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_words_are_told_apart_by_their_bytes(library):
    """Pairs on which sums of powers modulo 2**64 collide, words around the short limit, and one hash slot for all."""
    texts = [t for steps in (4, 10, 12) for t in swapped(steps)] + ["a" * n for n in range(14, 19)] + ["a" * n + "b" for n in range(14, 19)]
    encoder = bpe.Encoder(bpe.load_tables(PATH))
    want = [e.ids for e in library.encode_batch(texts * 2, add_special_tokens=False)]
    assert encode(encoder, texts * 2) == want and encode(encoder, texts) == want[:len(texts)]


def test_round_trip_is_one_python_pass(spark, capsys):
    """Two passes of one stage hold two Python workers for each task, and those stay while later steps run."""
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    round_trip(docs, PATH).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_long_batches_are_cut(spark, monkeypatch):
    """Runs of TEXT_BYTES at most, a longer text alone; rows and their other columns stay in order."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "TEXT_BYTES", 40)
    texts = ["some words of a text", None, "", "x" * 100, "last one", "naïve 🙂"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    tables = bpe.load_tables(PATH)
    got = list(bpe._decoded(bpe._encoded([batch], tables, "text", "ids"), tables, "ids", "decoded"))
    assert len(got) > 2
    assert [r for b in got for r in zip(b.column("doc_id").to_pylist(), b.column("decoded").to_pylist())] == [(i, t or "") for i, t in enumerate(texts)]

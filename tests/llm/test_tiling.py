"""String tiling and decontamination."""

import random

import numpy as np

from siteloom.llm import tiling


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing all places."""
    marked_d, marked_t, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while t + n < len(item) and p + n < len(doc) and item[t + n] == doc[p + n] and t + n not in marked_t and p + n not in marked_d:
                    n += 1
                best = max(best, (n, -t, -p))
        n, t, p = best[0], -best[1], -best[2]
        if n < least:
            return out
        marked_t |= set(range(t, t + n))
        marked_d |= set(range(p, p + n))
        out += n


def test_tiles_against_all_places():
    rnd = random.Random(1)
    for _ in range(60):
        item = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 25))], np.uint64)
        doc = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(0, 60))], np.uint64)
        tiles = tiling.tile(doc, item, 3)
        for t, p, n in tiles:
            assert (item[t:t + n] == doc[p:p + n]).all()
        cells = [x for t, _, n in tiles for x in range(t, t + n)]
        assert len(cells) == len(set(cells)) and len({x for _, p, n in tiles for x in range(p, p + n)}) == len(cells)
        assert sum(n for *_, n in tiles) == plain_tiles(doc.tolist(), item.tolist(), min(3, len(item)))


ITEM = " ".join(f"q{i}" for i in range(20))


def test_findings(spark, docs):
    words = ITEM.split()
    cases = {
        100: f"before {ITEM} after", 101: " ".join(words[10:] + ["and"] + words[:10]), 102: ITEM.upper().replace(" ", ", "),
        103: " ".join(words[:9]), 104: " ".join(words[::-1]), 105: "short one", 106: ITEM, 107: None}
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "short one", "x"), (3, "", "x"), (4, None, "x")], "item_id long, text string, doc_id string")
    df = docs.unionByName(spark.createDataFrame([(i, t, "e") for i, t in [*cases.items(), (106, ITEM)]], docs.schema))
    found = tiling.contaminated(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(100, 1), (101, 1), (102, 1), (106, 1), (105, 2)}
    assert len([r for r in found if r.doc_id == 106]) == 2
    turned, = [r for r in found if r.doc_id == 101]
    assert (turned.n_tiles, turned.matched_words, turned.coverage) == (2, 20, 1.0)
    left = tiling.clean(df, items)
    assert left.columns == df.columns
    assert left.count() == df.count() - 6
    assert tiling.clean(df, items.limit(0)).count() == df.count()
    assert tiling.clean(df.withColumnRenamed("sig", "key").withColumn("_bad", tiling.F.lit(1)), items).count() == df.count() - 6
    assert tiling.contaminated(df.limit(0), items).count() == 0


def test_items_without_id_and_with_several_texts(spark, docs):
    """Each text of an item counts, whatever its id."""
    other = " ".join(f"z{i}" for i in range(12))
    items = spark.createDataFrame([(None, ITEM), (5, other), (5, "third text of its own kind here"), (5, other)], "item_id long, text string")
    df = docs.unionByName(spark.createDataFrame([(100, f"x {ITEM} y", "e"), (101, other, "e"), (102, "the third text of its own kind here", "e")], docs.schema))
    found = sorted(((r.doc_id, r.item_id) for r in tiling.contaminated(df, items).collect()))
    assert found == [(100, None), (101, 5), (102, 5)]
    assert tiling.clean(df, items).count() == df.count() - 3

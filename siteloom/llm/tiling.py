"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased words. Documents and benchmark items are first joined on
shared runs of ``LEAST`` words; documents pass a bit table of the items' runs before that join, whose
size is fixed, so nothing that grows is sent to the tasks. Each pair that shares a run is then
tiled: Karp-Rabin looks for the longest matches of unmarked words, marks them longest first, and
goes on with shorter ones down to ``LEAST`` words. A document is contaminated by an item when the tiles
cover at least ``COVERAGE`` of the item's words, in whatever order its passages stand.

Defined cases: an item of fewer than ``LEAST`` words must occur as a whole; items and documents
without words, null or empty, match nothing; equal texts are tiled once and reported for each
row; of equally long matches the earlier in the item, then in the document is marked first; an item without
id counts and is reported with a null id; several texts under one item id are items of their own, equal rows
are one; extra columns, whatever their names, stay in :func:`clean`. Empty tables give no findings.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER, chunks, materialise, shingles, small_batches, word_hash, words

LEAST = 5
COVERAGE = 0.5
#: The bit table has 2 ** CELL_BITS words of 64 bits; a run sets two of its bits.
CELL_BITS = 18

#: Word bytes: digits, letters and all beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[65:91] = WORD_BYTES[128:] = True


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the words before each row (n + 1)."""
    raw = LOWER[raw]
    start, end, first = words(raw, at, WORD_BYTES)
    return word_hash(raw, start, end), first


def _runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of exactly ``size`` words per row; rows with fewer words have none."""
    got, row = shingles(hashes, first, size)
    if size > 1 and (np.diff(first) < size).any():
        enough = np.repeat(np.diff(first) >= size, np.diff(row))
        return got[enough], np.concatenate([[0], np.cumsum(np.where(np.diff(first) >= size, np.diff(row), 0))])
    return got, row


def item_runs(items: DataFrame) -> DataFrame:
    """Per row of ``items(item, text)`` the hashes of its runs, which have LEAST words or all of a shorter item: item, size, run."""

    def run(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "text"):
                h, first = word_hashes(raw, at)
                got, row = shingles(h, first, LEAST)
                count = np.diff(row)
                ids = batch.column("item").slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), count)))
                size = np.repeat(np.minimum(np.diff(first), LEAST), count)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(got.view(np.int64))], names=["item", "size", "run"])

    return small_batches(items).mapInArrow(run, "item long, size long, run long").distinct()


def _bit(run: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bit of the table for a run hash; the probes use different bits of it."""
    shift = 64 - CELL_BITS if probe == 0 else 64 - 2 * CELL_BITS - 6
    cell = (run >> np.uint64(shift)) & np.uint64((1 << CELL_BITS) - 1)
    return cell.astype(np.int64), (run >> np.uint64(shift - 6)) & np.uint64(63)


def bit_table(runs: DataFrame) -> np.ndarray:
    """Bits of the items' runs: 2 ** CELL_BITS words of 64 bits, whatever the number of items."""
    parts = []
    for probe in (0, 1):
        shift = 64 - CELL_BITS if probe == 0 else 64 - 2 * CELL_BITS - 6
        parts.append(runs.select(
            F.expr(f"shiftrightunsigned(run, {shift}) & {(1 << CELL_BITS) - 1}").alias("cell"),
            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(run, {shift - 6}) & 63 as int))").alias("bit")))
    table = np.zeros(1 << CELL_BITS, np.int64)
    for r in parts[0].unionByName(parts[1]).groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2 ** CELL_BITS rows
        table[r["cell"]] = r["bits"]
    return table.view(np.uint64)


def candidates(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts of ``texts(key, text)`` that hold runs of the bit table: key, text, hits (array of size and run).

    Only these texts go on; no other text is shuffled.
    """
    sizes = sorted(r[0] for r in runs.select("size").distinct().collect())  # at most LEAST numbers
    table = texts.sparkSession.sparkContext.broadcast(bit_table(runs))

    def hits_of(bits, h, first):
        """Row numbers, sizes and hashes of the runs whose bits are set."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size in sizes:
            got, row = _runs(h, first, size)
            hit = np.ones(len(got), bool)
            for probe in (0, 1):
                cell, bit = _bit(got, probe)
                hit &= ((bits[cell] >> bit) & np.uint64(1)).astype(bool)
            at_hit = np.flatnonzero(hit)
            owner = np.searchsorted(row, at_hit, side="right") - 1
            both = np.unique(np.stack([owner, got[at_hit].view(np.int64)]), axis=1)
            out.append((both[0], np.full(both.shape[1], size), both[1]))
        return (np.concatenate(c) for c in zip(*out))

    def run(batches):
        bits = table.value
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "text"):
                owner, size, got = hits_of(bits, *word_hashes(raw, at))
                if not len(owner):
                    continue
                order = np.argsort(owner, kind="stable")
                rows, count = np.unique(owner, return_counts=True)
                entries = pa.StructArray.from_arrays([pa.array(size[order]), pa.array(got[order])], names=["size", "run"])
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), entries)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("key", "text")), hits], names=["key", "text", "hits"])

    return small_batches(texts).mapInArrow(run, "key string, text string, hits array<struct<size: long, run: long>>")


def _hashes(words_: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words_) - size + 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + words_[j:j + len(out)]
    return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) of two sequences of word hashes."""
    least = min(least, len(item))
    if not least:
        return []
    doc_marked, item_marked, found = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    size = max(least, len(item) // 2)
    while True:
        in_item, in_doc = _free(item_marked, size), _free(doc_marked, size)
        h_item, h_doc = _hashes(item, size)[in_item], _hashes(doc, size)[in_doc]
        order = np.argsort(h_doc, kind="stable")
        lo, hi = np.searchsorted(h_doc[order], h_item), np.searchsorted(h_doc[order], h_item, side="right")
        matches, longest = [], 0
        for t, a, b in zip(in_item.tolist(), lo.tolist(), hi.tolist()):
            for p in in_doc[order[a:b]].tolist():
                if t and p and item[t - 1] == doc[p - 1] and not item_marked[t - 1] and not doc_marked[p - 1]:
                    continue  # part of a match that starts earlier
                n = min(len(item) - t, len(doc) - p)
                stop = np.flatnonzero((item[t:t + n] != doc[p:p + n]) | item_marked[t:t + n] | doc_marked[p:p + n])
                n = int(stop[0]) if len(stop) else n
                if n >= size:
                    matches.append((-n, t, p))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(matches)
        while matches:
            n, t, p = heapq.heappop(matches)
            taken = item_marked[t:t - n] | doc_marked[p:p - n]
            if not taken.any():
                item_marked[t:t - n] = doc_marked[p:p - n] = True
                found.append((t, p, -n))
                continue
            # The free rests of an overlapped match stay in the race.
            edge = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
            for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                if hi - lo >= size:
                    heapq.heappush(matches, (lo - hi, t + lo, p + lo))
        if size == least:
            return found
        size = max(least, size // 2)


def findings(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, text: str = "text", item_text: str = "text") -> DataFrame:
    """Contaminated texts: key (MD5 of the text), item_id, n_tiles, matched_words, item_words, coverage."""
    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"), F.col(text).alias("text"))
    # Items are told apart by a number of their own, not by an id that may be null or stand on several texts.
    items = materialise(items.select("item_id", F.col(item_text).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    runs = materialise(item_runs(items.select("item", "text")), "item_runs")
    some = materialise(candidates(texts, runs), "tiling_texts").dropDuplicates(["key"])
    pairs = some.select("key", F.inline("hits")).join(runs, ["size", "run"]).select("key", "item").distinct()
    both = (pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
            .join(some.select("key", "text"), "key").select("key", "item_id", "item_text", "text"))

    def run(batches):
        for batch in batches:
            rows = []
            for part in range(batch.num_rows):
                one = batch.slice(part, 1)
                (_, _, a, a_at), = chunks(one, "item_text")
                (_, _, b, b_at), = chunks(one, "text")
                item, doc = word_hashes(a, a_at)[0], word_hashes(b, b_at)[0]
                tiles = tile(doc, item)
                n = sum(t[2] for t in tiles)
                if len(item) and n >= coverage * len(item):
                    rows.append((one.column("key")[0].as_py(), one.column("item_id")[0].as_py(), len(tiles), n, len(item), n / len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "item_id", "n_tiles", "matched_words", "item_words", "coverage"])

    return both.mapInArrow(run, "key string, item_id long, n_tiles long, matched_words long, item_words long, coverage double")


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per contaminated document and item: id, item_id, n_tiles, matched_words, item_words, coverage."""
    found = materialise(findings(docs, items, coverage, text), "contaminated")
    keys = docs.select(F.col(id_col), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"))
    return keys.join(found, "key").drop("key")


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that no item contaminates, with all their columns."""
    bad = materialise(findings(docs, items, coverage, text).select("key").distinct(), "contaminated")
    return docs.join(bad.hint("merge"), F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")) == bad["key"], "left_anti")

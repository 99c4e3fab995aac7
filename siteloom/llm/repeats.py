"""Repeated byte strings by the interval tree of an enhanced suffix array.

Texts are UTF-8 bytes; a repeat has at least ``LEAST`` bytes and never crosses documents. Every
window of LEAST bytes has an anchor: the smallest hash among its runs of ``GRAM`` bytes. The anchor
is a function of the window alone, so equal windows meet in one group; adjacent windows with one anchor
form a piece of text (at most ``WIDE`` windows), and only pieces, not suffixes, are shuffled. Equal
pieces are settled by their hash, first where they are read. What differs within an anchor's group is fetched,
and its suffixes are sorted into a suffix array; a stack scan of the common prefix lengths gives
the interval tree, and intervals whose occurrences have different left neighbours are the maximal
repeats, with all their occurrences. Suffixes are bucketed by the hash of their first LEAST bytes, as
only intervals at least that deep count, and sorted by their bytes within. A repeat longer than a piece is a chain of
overlapping repeats of pieces.

A byte goes when a window that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. All is judged on the input.

Skew: a hot group streams through its task in sorted order with one row kept; groups with more than ``HOT``
differing pieces are counted off by window hash with partial aggregation instead of sorted in one task.

Defined cases: a null text is empty; texts under LEAST bytes have no repeat; rows that are equal in id
and text are one document; several texts with one id, and null ids, are ranked by text
after the id, null last; a document that is covered whole keeps no byte. Extra columns stay in :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, mix, powers, prefix_hash, small_batches, span_hash

LEAST = 100
GRAM = 24
#: Windows of one piece.
WIDE = 256
#: Bytes of text that are cut into pieces at a time: some twenty tables of eight times their size stand beside them.
CUT_BYTES = 1 << 17
#: Pieces gathered before those equal within a task are settled.
FLUSH = 300_000
#: Bytes of pieces sorted at a time, and pieces of a group sorted in one task.
SORT_BYTES = 1 << 18
#: Suffixes sorted at a time (a bucket of equal windows is not cut), and rows of an output batch.
PART = 1 << 16
OUT_ROWS = 1 << 16
HOT = 32_768
_U = np.uint64


def _slide(pick, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def anchors(raw: np.ndarray, at: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of the rows: anchor, hash, row, start in the row, bytes (negative: the anchor occurs twice in it)."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < least:
        return none.view(_U), none.view(_U), none, none, none
    prefix = prefix_hash(raw)
    _, down = powers(n + 1)
    every = mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
    width, m = least - gram + 1, n - least + 1
    low = _slide(np.minimum, every, width)
    size = np.diff(at)
    ok = np.zeros(m + 1, np.int8)
    long = np.flatnonzero(size >= least)
    ok[at[long]] += 1
    ok[at[long] + size[long] - least + 1] -= 1
    ok = np.cumsum(ok)[:m].astype(bool)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    new[at[long]] = True
    start = np.flatnonzero(new)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    stop = np.flatnonzero(last)
    parts = (stop - start) // WIDE + 1
    if (parts > 1).any():
        which = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop = start[which] + nth * WIDE, np.minimum(stop[which], start[which] + nth * WIDE + WIDE - 1)
    row = np.searchsorted(at, start, side="right") - 1
    end = stop + least
    # Grams that are the minimum of some window; two of one piece's anchor mean equal windows may lie in it.
    padded = np.concatenate([np.zeros(width - 1, _U), np.where(ok, low, _U(0)), np.zeros(width - 1, _U)])
    chosen = np.flatnonzero(_slide(np.maximum, padded, width) == every)
    lo, hi = np.searchsorted(chosen, start), np.searchsorted(chosen, stop + width)
    count = hi - lo
    which = np.repeat(np.arange(len(start)), count)
    near = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    twice = np.bincount(which, weights=every[chosen[near]] == low[start][which], minlength=len(start)) > 1
    return low[start], span_hash(prefix, start, end), row, start - at[row], np.where(twice, start - end, end - start)


def firsts(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flags of entries that no entry of the same key precedes in (document, start) order."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d == d[head]) & (s == s[head])
    return out


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    top = np.empty_like(end)
    # Running maximum of the end within a document: documents are told apart by a large step.
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    step = int(end.max()) + 1
    top = np.maximum.accumulate(end + rank * step) - rank * step
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(top, head)


_PIECE = "anchor long, piece long, doc long, start long, size long"


def pieces(docs: DataFrame) -> DataFrame:
    """First pieces of each task (bytes negative as in :func:`anchors`), and spans known to be repeated there (piece null)."""

    def run(batches):
        held, count = [], 0

        def flush():
            anchor, key, doc, start, size = (np.concatenate(c) for c in zip(*held))
            first = firsts(key, doc, start)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor[first].view(np.int64), key[first].view(np.int64), doc[first], start[first], size[first])],
                                             names=["anchor", "piece", "doc", "start", "size"])
            d, a, b = merge(doc[~first], start[~first], (start + np.abs(size))[~first])
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(mix(d.view(_U)).view(np.int64)), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(a), pa.array(b - a)],
                                                 names=["anchor", "piece", "doc", "start", "size"])

        for batch in batches:
            docs_ = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, _, raw, at in chunks(batch, "text", CUT_BYTES):
                anchor, key, row, start, size = anchors(raw, at)
                held.append((anchor, key, docs_[lo:][row].astype(np.int64), start, size))
                count += len(row)
                if count >= FLUSH:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return small_batches(docs).mapInArrow(run, _PIECE)


def settle(rows: DataFrame) -> DataFrame:
    """Stream sorted pieces: repeated spans (fine false), and first pieces of groups that hold several (fine true)."""

    def run(batches):
        before = None  # the last row: anchor, piece, doc and start of its first, whether the anchor had another piece
        pending = None  # the first piece of an anchor, until a second one shows
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, doc, start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc", "start", "size"))
            known = np.asarray(batch.column("piece").is_null())
            piece = batch.column("piece").fill_null(0).to_numpy(zero_copy_only=False)
            out = [(anchor[known], doc[known], start[known], size[known], np.zeros(known.sum(), bool))]
            anchor, piece, doc, start, size = (c[~known] for c in (anchor, piece, doc, start, size))
            twice, size = size < 0, np.abs(size)
            n = len(anchor)
            if n:
                same_anchor, same_piece = np.zeros(n, bool), np.zeros(n, bool)
                same_anchor[1:] = anchor[1:] == anchor[:-1]
                if before is not None:
                    same_anchor[0] = anchor[0] == before[0]
                    same_piece[0] = same_anchor[0] and piece[0] == before[1]
                same_piece[1:] = same_anchor[1:] & (piece[1:] == piece[:-1])
                head = np.maximum.accumulate(np.where(same_piece, -1, np.arange(n)))
                fd = np.where(head >= 0, doc[head], before[2] if before else 0)
                fs = np.where(head >= 0, start[head], before[3] if before else 0)
                again = same_piece & ((doc != fd) | (start != fs))
                out.append((anchor[again], doc[again], start[again], size[again], np.zeros(again.sum(), bool)))
                first = np.flatnonzero(~same_piece)
                # A first piece needs sorting if its anchor had a piece before, or gets one after it.
                more = same_anchor[first].copy()
                follows = np.zeros(len(first), bool)
                follows[:-1] = more[1:]
                if len(first) and more[0] and pending is not None:
                    out.append(tuple(np.array([v]) for v in pending) + (np.ones(1, bool),))
                if len(first):
                    pending = None
                fine = first[more | follows | twice[first]]
                out.append((anchor[fine], doc[fine], start[fine], size[fine], np.ones(len(fine), bool)))
                if len(first) and not more[-1] and not twice[first[-1]]:
                    i = first[-1]
                    pending = (anchor[i], doc[i], start[i], size[i])
                before = (anchor[-1], piece[-1], fd[-1], fs[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "doc", "start", "size", "fine"])

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "piece", "doc", "start")
    return ordered.mapInArrow(run, "anchor long, doc long, start long, size long, fine boolean")


def suffix_arrays(raw: np.ndarray, at: np.ndarray, least: int = LEAST):
    """Suffixes of the rows that share at least ``least`` bytes with another: places in order, common prefix lengths.

    ``lcp[i]`` is that of suffixes i - 1 and i, 0 at the begin of a bucket. Parts of whole buckets are
    yielded one after the other, which bounds what is sorted at a time.
    """
    size = np.diff(at)
    count = np.maximum(size - least + 1, 0)
    place = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bucket = span_hash(prefix_hash(raw), place, place + least)
    order = np.argsort(bucket, kind="stable")
    place, bucket = place[order], bucket[order]
    same = bucket[1:] == bucket[:-1]
    twin = np.zeros(len(place), bool)
    twin[1:] |= same
    twin[:-1] |= same
    place, bucket = place[twin], bucket[twin]
    if not len(place):
        return
    # The eight bytes from each place as one number, a view.
    word = np.ndarray((len(raw) + 1,), ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    del order
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    lo = 0
    while lo < len(place):
        after = np.searchsorted(heads, lo + PART)
        hi = int(heads[after]) if after < len(heads) else len(place)
        yield _sorted(place[lo:hi], bucket[lo:hi], at, word, least)
        lo = hi


def _sorted(place, bucket, at, word, least) -> tuple[np.ndarray, np.ndarray]:
    end = at[np.searchsorted(at, place, side="right")]
    left = end - place - least
    tails = []
    for j in range(0, int(left.max()), 8):
        inside = np.clip(left - j, 0, 8)
        mask = np.where(inside > 0, (~_U(0)) << (_U(8) * (8 - np.maximum(inside, 1)).astype(_U)), _U(0))
        tails.append(word[np.minimum(place + least + j, len(word) - 1)].astype(_U) & mask)
    order = np.lexsort((left, *reversed(tails), bucket))
    place, left, bucket = place[order], left[order], bucket[order]
    lcp, going = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    going[1:] = bucket[1:] == bucket[:-1]
    lcp[going] = least
    for t in tails:
        t = t[order]
        diff = np.zeros(len(t), _U)
        diff[1:] = t[1:] ^ t[:-1]
        same = np.zeros(len(t), np.int64)
        for j in range(8):
            same += (diff >> _U(56 - 8 * j)) == 0
        lcp[going] += same[going]
        going &= same == 8
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]) + least)
    lcp[1:][bucket[1:] != bucket[:-1]] = 0
    return place, lcp


def scan(lcp: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Interval tree by a stack scan: depth, first and last suffix of each interval, and per suffix its deepest interval but one.

    The last result is, for each suffix, the deepest interval of which it is not the first occurrence
    (-1: none). A child hands only its first occurrence on to its parent, so every suffix is settled once.
    """
    n = len(lcp)
    depth, lo, hi, owner = [], [], [], [-1] * n
    ranks, stack = rank.tolist(), []  # of interval, first occurrence
    for i, value in enumerate([*lcp.tolist()[1:], 0]):
        begin = carry = i
        while stack and depth[stack[-1][0]] > value:
            number, first = stack.pop()
            if ranks[carry] < ranks[first]:
                first, carry = carry, first
            if ranks[carry] != ranks[first]:
                owner[carry] = number
            hi[number], begin, carry = i, lo[number], first
        if not value:
            continue
        if stack and depth[stack[-1][0]] == value:
            number, first = stack[-1]
            if ranks[carry] < ranks[first]:
                first, carry = carry, first
                stack[-1] = (number, first)
            if ranks[carry] != ranks[first]:
                owner[carry] = number
        else:
            stack.append((len(depth), carry))
            depth.append(value)
            lo.append(begin)
            hi.append(i)
    return tuple(np.array(x, np.int64) for x in (depth, lo, hi, owner))


def maximal(raw: np.ndarray, at: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Flags of intervals whose occurrences have different bytes on their left, or one of which has none."""
    opens = at[np.searchsorted(at, place, side="right") - 1] == place
    before = np.where(opens, np.arange(len(place)) + 256, raw[place - 1])
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return change[hi] > change[lo]


def trees(raw, at, doc, start, least: int = LEAST):
    """Interval trees part by part: documents and starts of the suffixes, depth, first and last suffix, maximal flag, owners."""
    for place, lcp in suffix_arrays(raw, at, least):
        row = np.searchsorted(at, place, side="right") - 1
        d, s = doc[row], start[row] + place - at[row]
        rank = np.empty(len(place), np.int64)
        order = np.lexsort((s, d))
        # Equal (document, start) of two pieces is one occurrence.
        rank[order] = np.cumsum(np.concatenate([[0], (d[order][1:] != d[order][:-1]) | (s[order][1:] != s[order][:-1])]))
        depth, lo, hi, owner = scan(lcp, rank)
        yield d, s, depth, lo, hi, maximal(raw, at, place, lo, hi), owner


def occurrences(raw, at, doc, start, least: int = LEAST):
    """All occurrences of the maximal repeats of pieces, part by part: repeat, length, document, start."""
    number = 0
    for d, s, depth, lo, hi, top, _ in trees(raw, at, doc, start, least):
        depth, lo, hi = depth[top], lo[top], hi[top]
        n = hi - lo + 1
        which = np.repeat(np.arange(len(lo)), n)
        at_ = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield number + which, depth[which], d[at_], s[at_]
        number += len(lo)


def repeated(raw, at, doc, start, least: int = LEAST):
    """Spans of pieces that a maximal repeat with an earlier occurrence covers, merged: document, start, end.

    What a repeat that is not maximal covers, the one that extends it to the left covers too.
    """
    for d, s, depth, _, _, top, owner in trees(raw, at, doc, start, least):
        later = np.flatnonzero(owner >= 0)
        later = later[top[owner[later]]]
        yield merge(d[later], s[later], s[later] + depth[owner[later]])


def _groups(batches):
    """Runs of whole anchor groups of sorted batches, of about SORT_BYTES each."""
    held, size, last = [], 0, None
    for batch in batches:
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        lengths = batch.column("content").nbytes / max(1, batch.num_rows)
        lo = 0
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        if last is not None and len(anchor) and anchor[0] != last:
            cuts = np.concatenate([[0], cuts])
        for cut in cuts.tolist():
            if size + (cut - lo) * lengths >= SORT_BYTES:
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, size, lo = [], 0, cut
        if batch.num_rows > lo:
            held.append(batch.slice(lo))
            size += (batch.num_rows - lo) * lengths
        if len(anchor):
            last = anchor[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def contents(texts: DataFrame, fine: DataFrame) -> DataFrame:
    """The bytes of pieces: anchor, doc, start, content."""
    lists_ = fine.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("cuts"))  # a document's own pieces
    both = small_batches(texts.join(lists_, "doc").select("doc", "text", "cuts"))

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                text, doc = (batch.column("text")[one].as_py() or "").encode(), batch.column("doc")[one].as_py()
                cuts = batch.column("cuts")[one].values
                anchor, start, size = (cuts.field(i) for i in range(3))
                data = [text[a:a + b] for a, b in zip(start.to_pylist(), size.to_pylist())]
                yield pa.RecordBatch.from_arrays([anchor, pa.array([doc] * len(data), pa.int64()), start, pa.array(data, pa.binary())], names=["anchor", "doc", "start", "content"])

    return both.mapInArrow(run, "anchor long, doc long, start long, content binary")


def _pieces_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    data = table.column("content").to_pylist()
    at = np.concatenate([[0], np.cumsum(np.array([len(x) for x in data], np.int64))])
    return np.frombuffer(b"".join(data), np.uint8), at, table.column("doc").to_numpy(), table.column("start").to_numpy()


def _in_groups(parts: DataFrame) -> DataFrame:
    return small_batches(parts.repartition("anchor").sortWithinPartitions("anchor", "doc", "start"))


def repeats(parts: DataFrame) -> DataFrame:
    """Maximal repeats within anchor groups of ``parts(anchor, doc, start, content)``, every occurrence: repeat, length, doc, start."""

    def run(batches):
        for table in _groups(batches):
            name = _U(int(table.column("anchor")[0].as_py()) & ((1 << 64) - 1))
            for which, *columns in occurrences(*_pieces_of(table)):
                for lo in range(0, len(which), OUT_ROWS):
                    part = slice(lo, lo + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(mix(which[part].astype(_U) ^ name).view(np.int64)), *(pa.array(c[part]) for c in columns)],
                                                     names=["repeat", "length", "doc", "start"])

    return _in_groups(parts).mapInArrow(run, "repeat long, length long, doc long, start long")


def repeated_spans(parts: DataFrame) -> DataFrame:
    """Spans of ``parts`` that start earlier too: doc, start, size."""

    def run(batches):
        for table in _groups(batches):
            for doc, start, end in repeated(*_pieces_of(table)):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end - start)], names=["doc", "start", "size"])

    return _in_groups(parts).mapInArrow(run, "doc long, start long, size long")


def repeated_windows(parts: DataFrame) -> DataFrame:
    """The same decision for hot groups, window by window: doc, start, size of windows that start earlier too."""

    def run(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "content"):
                count = np.diff(at) - LEAST + 1
                row = np.repeat(np.arange(hi - lo), count)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                key = span_hash(prefix_hash(raw), at[row] + place, at[row] + place + LEAST)
                doc, start = (batch.column(c).to_numpy()[lo:hi][row] for c in ("doc", "start"))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(start + place)], names=["window", "doc", "start"])

    windows = materialise(small_batches(parts).mapInArrow(run, "window long, doc long, start long"), "hot_windows")
    head = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("head"), F.count("*").alias("n")).where("n > 1").select("window", "head")
    return windows.join(head, "window").where(F.struct("doc", "start") > F.col("head")).select("doc", "start", F.lit(LEAST).cast("long").alias("size"))


def keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, Column]:
    """Documents as (doc, text) with a unique rank, and the condition that joins them back to a row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    twice = plain.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 OR doc IS NULL").limit(1)
    if twice.isEmpty():
        return plain, F.col(id_col).cast("long") == F.col("_doc")
    own = materialise(plain.withColumn("md5", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).groupBy("doc", "md5").agg(F.first("text").alias("text"))
                      .orderBy(F.col("doc").asc_nulls_last(), "md5").select(F.col("doc").alias("own"), "md5", "text", F.monotonically_increasing_id().alias("doc")), "ranked")
    return own, F.col(id_col).cast("long").eqNullSafe(F.col("_own")) & (F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")) == F.col("_md5"))


def spans(texts: DataFrame) -> DataFrame:
    """Repeated spans of ``texts(doc, text)``, which may overlap: doc, start, size."""
    texts = texts.select("doc", "text")
    settled = materialise(settle(pieces(texts)), "pieces")
    fine = settled.where("fine").select("anchor", "doc", "start", "size")
    parts = contents(texts, fine)
    hot = fine.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor")
    hot = materialise(hot, "hot_anchors")
    out = settled.where("NOT fine").select("doc", "start", "size")
    if not hot.isEmpty():
        parts = materialise(parts, "piece_contents")
        out = out.unionByName(repeated_windows(parts.join(hot, "anchor", "left_semi")))
        parts = parts.join(hot, "anchor", "left_anti")
    return out.unionByName(repeated_spans(parts))


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: the merged repeated byte spans of each text, as array<struct<start, end>> in order."""
    texts, condition = keyed(docs, id_col, text)
    found = spans(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # a document's own spans
    if "md5" in texts.columns:
        found = found.join(texts.select("doc", "own", "md5"), "doc").select(F.col("own").alias("_own"), F.col("md5").alias("_md5"), "spans")
    else:
        found = found.withColumnRenamed("doc", "_doc")
    return docs.join(found, condition, "left").select(*[docs[c] for c in docs.columns], "spans")


def cut(text: bytes, spans_: pa.Array) -> tuple[list[tuple[int, int]], list[bytes]]:
    """Merged spans and what is left between them."""
    if spans_ is None or not len(spans_):
        return [], [text]
    start, size = (spans_.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    _, a, b = merge(np.zeros(len(start), np.int64), start, start + size)
    a, b = a.tolist(), b.tolist()
    return list(zip(a, b)), [text[x:y] for x, y in zip([0, *b], [*a, len(text)])]


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            rows = []
            for body, s in zip(batch.column("text"), batch.column("spans")):
                body = (body.as_py() or "").encode()
                gone, left = cut(body, s.values)
                rows.append((len(body), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(left)).hexdigest()))
            columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = small_batches(removed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", "text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; a character that a span cuts in part stays."""
    if "spans" in docs.columns:
        raise ValueError("column spans exists already")

    def run(batches):
        for batch in batches:
            kept = []
            for body, s in zip(batch.column(text), batch.column("spans")):
                if body.as_py() is None or s.values is None or not len(s.values):
                    kept.append(body.as_py())
                    continue
                body = body.as_py().encode()
                gone, _ = cut(body, s.values)
                at, out = 0, []
                for a, b in gone:
                    while a < b and body[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                        b -= 1
                    out.append(body[at:a])
                    at = b
                kept.append(b"".join([*out, body[at:]]).decode())
            columns = [pa.array(kept, pa.string()) if n == text else batch.column(n) for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "spans"])

    return small_batches(removed(docs, id_col, text)).mapInArrow(run, T.StructType(docs.schema.fields))

"""Near-duplicate documents by SimHash and anchor-point covering.

A fingerprint has 64 bits, each the majority of that bit in the XXH64 values of a text's runs of ``k`` words, repeats
included. Fingerprints that differ in ``distance`` bits or fewer are linked, and components of the links returned.

Anchors are the words of a covering code: the perfect binary Golay code of length 23, covering radius 3, on bits 0-22 and again
on bits 23-45; the other bits take no part in the choice of anchors. Each fingerprint has one home, the anchor
within the radius in both halves. It is copied to every anchor whose halves exceed the radius by ``distance`` bits
together at most. If x and y differ in ``distance`` bits, y is within radius plus distance of the home of x: so comparing the homes
of an anchor with all fingerprints copied there finds every link. A copy costs two longs, and there are 61 of a fingerprint
on average at distance 2.

Copies of one text are one fingerprint from the start. Rows of an anchor come sorted, homes first, so a task holds the homes of one
anchor and one batch; links of a batch leave as a forest, at most one row per fingerprint. An anchor that is
home to more than ``HOMES`` fingerprints is not compared at all: its fingerprints are copied to all words within half the distance instead.
Linked ones share such a word, and a word has 65 such neighbours (distance 2), so these groups are bounded.

Defined cases: words are the runs outside blanks and control space after lower-casing A-Z; a text with fewer than ``k``
words is one run of all of them; a null, empty or wordless text has fingerprint zero and is linked like any other.
Rows of one id are one document: their fingerprints are linked. A row with a null id links as others do but gives no name; a component
of such rows alone has a null name. The smallest id names a component. A long text is hashed in slices. Other
columns, whatever their names, are ignored. No rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, materialise, small_batches, words
from .graph import components
from .minhash import WORD_BYTES

SEED = 42
BITS = 64
#: Runs hashed at a time.
SLICE = 1 << 16
#: Homes of one anchor that are held in memory; beyond, fingerprints meet at the words around them.
HOMES = 512
#: Pairs compared at a time.
PAIRS = 1 << 21

# Length, covering radius and generator polynomial of the binary Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
HALF = (1 << LENGTH) - 1

_CODE: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit of 64-bit values; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), SLICE):
        octets = hashes[lo:lo + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints_of(raw: np.ndarray, at: np.ndarray, k: int) -> list[int]:
    """Fingerprints of the rows of a flat byte array."""
    raw = LOWER[raw]
    start, end, first = words(raw, at, WORD_BYTES)
    # Words with one blank between: what follows a word in its row is a blank of some kind.
    keep = WORD_BYTES[raw]
    inner = end[~np.isin(end, at)]
    raw[inner] = 32
    keep[inner] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    body, start, end = raw[keep].tobytes(), place[start], place[end]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        runs = max(b - a - k + 1, min(b - a, 1))
        last = min(a + k, b) - 1
        hashes = np.empty(runs, np.uint64)
        for lo in range(0, runs, SLICE):
            hi = min(runs, lo + SLICE)
            hashes[lo:hi] = [xxhash.xxh64_intdigest(body[s:e], SEED) for s, e in zip(start[a + lo:a + hi].tolist(), end[last + lo:last + hi].tolist())]
        out.append(fingerprint(hashes))
    return out


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "text"):
                values = np.array(fingerprints_of(raw, at, k), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(values)], names=["doc_id", "fp"])

    return small_batches(docs).mapInArrow(run, "doc_id long, fp long")


def code(distance: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndrome of each byte at each of three places, and by excess over the radius: patterns by syndrome, starts, counts.

    A word and an anchor differ by a pattern of the word's syndrome. Excess 0 are the patterns up to the radius, one per syndrome.
    """
    if distance not in _CODE:
        unit = [1 << i for i in range(LENGTH - 12)]
        for i in range(LENGTH - 12, LENGTH):
            s = unit[-1] << 1
            unit.append(s ^ GENERATOR if s >> 11 else s)
        octet = np.zeros((3, 256), np.int64)
        for place in range(3):
            for i in range(8):
                if 8 * place + i < LENGTH:
                    octet[place] ^= np.where(np.arange(256) >> i & 1, unit[8 * place + i], 0)
        tiers = []
        for excess in range(distance + 1):
            weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
            found = np.array([(sum(1 << i for i in c), int(np.bitwise_xor.reduce([unit[i] for i in c] or [0]))) for w in weights for c in combinations(range(LENGTH), w)])
            found = found[np.argsort(found[:, 1], kind="stable")]
            count = np.bincount(found[:, 1], minlength=1 << 11)
            tiers.append((found[:, 0], np.cumsum(count) - count, count))
        _CODE[distance] = octet, tiers
    return _CODE[distance]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and running number of ``count`` rows for each entry."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def anchors_of(fps: np.ndarray, distance: int, home: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within reach: anchor, whether it is beyond the radius, and the row of ``fps``; homes alone if asked."""
    octet, tiers = code(distance)
    halves = [fps & HALF, (fps >> LENGTH) & HALF]
    syndrome = [octet[0][h & 255] ^ octet[1][h >> 8 & 255] ^ octet[2][h >> 16] for h in halves]
    anchor, far, row = [], [], []
    for one in range(distance + 1):
        for two in range(distance + 1 - one):
            if home and one + two:
                continue
            (p1, s1, c1), (p2, s2, c2) = tiers[one], tiers[two]
            n1, n2 = c1[syndrome[0]], c2[syndrome[1]]
            owner, j = _spread(n1 * n2)
            i, j = j // n2[owner], j % n2[owner]
            near = halves[0][owner] ^ p1[s1[syndrome[0][owner]] + i]
            anchor.append(near | (halves[1][owner] ^ p2[s2[syndrome[1][owner]] + j]) << LENGTH)
            far.append(np.full(len(owner), one + two > 0))
            row.append(owner)
    return np.concatenate(anchor), np.concatenate(far), np.concatenate(row)


def copies(marks: DataFrame, distance: int, home: bool = False) -> DataFrame:
    """Rows of ``marks(fp)`` at each anchor in reach: anchor, far, fp."""

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 1024):
                part = fps[lo:lo + 1024]
                anchor, far, row = anchors_of(part, distance, home)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(far), pa.array(part[row])], names=["anchor", "far", "fp"])

    return marks.select("fp").mapInArrow(run, "anchor long, far boolean, fp long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the same components as the links u-v: each vertex but the least to the least one."""
    nodes, inner = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inner[:len(u)], inner[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            own = label != np.arange(len(nodes))
            return nodes[own], nodes[label[own]]
        label = after


def compared(anchor: np.ndarray, far: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between homes and copies of the same anchor; rows are sorted by anchor, homes first."""
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(head, len(anchor)))
    group = np.repeat(np.arange(len(head)), size)
    homes = np.flatnonzero(~far & (size[group] > 1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    work = np.cumsum(size[group[homes]])
    lo = 0
    while lo < len(homes):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + PAIRS, side="right")))
        g = group[homes[lo:hi]]
        owner, j = _spread(size[g])
        a, b = fps[homes[lo:hi]][owner], fps[head[g][owner] + j]
        link = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        x, y = forest(a[link], b[link])
        left.append(x)
        right.append(y)
        lo = hi
    return forest(np.concatenate(left), np.concatenate(right))


def meet(rows: DataFrame, distance: int) -> DataFrame:
    """Links within the anchors of ``rows(anchor, far, fp)``: a, b."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, far, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "far", "fp"))
            if held is not None:
                anchor, far, fps = (np.concatenate(pair) for pair in zip(held, (anchor, far, fps)))
            a, b = compared(anchor, far, fps, distance)
            # Homes of the last anchor go on: more of its rows may follow.
            stay = np.flatnonzero((anchor == anchor[-1]) & ~far)
            held = anchor[stay], far[stay], fps[stay]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "far").mapInArrow(run, "a long, b long")


def meet_between(marks: DataFrame, distance: int) -> DataFrame:
    """Links of ``marks(fp)`` through the words within half the distance of both: a, b."""
    flips = [sum(1 << i for i in c) for w in range(distance // 2 + 1) for c in combinations(range(BITS), w)]
    flips = np.array(flips, np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 1024):
                part = fps[lo:lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips)))], names=["word", "fp"])

    around = materialise(marks.mapInArrow(run, "word long, fp long"), "between")
    least = around.groupBy("word").agg(F.min("fp").alias("b"))
    return around.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(marks: DataFrame, distance: int) -> DataFrame:
    """Edges between the same components as all links of the distinct fingerprints ``marks(fp)``: a, b."""
    home = copies(marks, distance, home=True)
    full = materialise(home.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOMES).select("anchor"), "full_anchors")
    rows = copies(marks, distance)
    if full.isEmpty():
        return meet(rows, distance)
    crowd = materialise(rows.join(full, "anchor", "left_semi").select("fp").distinct(), "crowded")
    return meet(rows.join(full, "anchor", "left_anti"), distance).unionByName(meet_between(crowd, distance))


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id (smallest id reachable)."""
    if distance not in (0, 2, 4):
        raise ValueError("distance must be 0, 2 or 4")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialise(fingerprints(docs, k), "simhash")
    marks = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    twice = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("hi")).where("b <> hi").select("doc_id", "b")
    same = rows.join(twice, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    labels = components(links(marks, distance).unionByName(same))
    classes = (marks.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
               .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(materialise(classes.join(names, "component").select("fp", "component_id"), "named"), "fp").select("doc_id", "fp", "component_id")

"""Vector helpers on the bytes of whole Arrow batches, and table plumbing.

Texts are handled as one flat byte array with row offsets, so that hashing and
tokenising cost a few numpy passes per batch and no Python work per word. All
helpers treat a null text as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteloom.session import materialise, new_path, scratch_dir

__all__ = ["materialise", "new_path", "scratch_dir"]

#: Rows and bytes of one Arrow batch: bound what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Bytes of text that are worked on at a time (a longer single text goes alone).
CHUNK_BYTES = 2 << 20

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
TAB = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_POW: dict[str, np.ndarray] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of this session's Python stages."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def few_files(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialise` for rows of a few numbers, in as many files as tasks run at once.

    For each file that it writes to a local folder, an executor starts processes of its own (Hadoop's file system sets modes by
    ``chmod``), and each counts with the whole memory of the executor until it runs. Small tables in loops go without them.
    """
    return materialise(df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism)), label)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, at least ``n``."""
    have = _POW.get("up")
    if have is None or len(have) < n:
        # Two tables stay in every worker: no longer than its chunks ask for.
        size = max(n, min(CHUNK_BYTES + 1, 1 << n.bit_length()))
        for name, base in (("up", BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 row offsets in them."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, count=n + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch in runs of rows of at most ``limit`` text bytes: (from, to, bytes, offsets)."""
    raw, at = flat(batch.column(text))
    limit, lo, n = limit or CHUNK_BYTES, 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of [s, e) is (p[e] - p[s]) * down[s]."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(TAB[raw] * up[:len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512
_MASKS = np.array([(1 << 8 * b) - 1 for b in range(9)], np.uint64)


def octets(raw: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there as one number (zeros beyond the end); a view."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def block(eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bytes, eight at most, from each place of :func:`octets`."""
    return eight[np.minimum(start, len(eight) - 1)] & _MASKS[np.clip(size, 0, 8)]


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of [start, end): eight bytes at a time, scrambled after each step.

    Unlike sums of powers it has no structured collisions on long words of few letters.
    """
    eight, size = octets(raw), end - start
    out = mix((size.astype(np.uint64) + _U(1)) * _U(BASE))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        out[live] = mix((out[live] ^ block(eight, start[live] + done, size[live] - done)) * _U(BASE))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(blake2b(raw[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside``: starts, ends, and words before each row (n + 1)."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    is_in = inside[raw]
    start = is_in.copy()
    start[1:] &= ~is_in[:-1] | edge[1:n]
    end = is_in.copy()
    end[:-1] &= ~is_in[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words per row, and runs before each row (n + 1).

    A row of 1 to k - 1 words has one run: all of them. A row without words has none.
    """
    counts = np.diff(first)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        full = np.full(len(hashes) - k + 1, k, np.uint64)
        for j in range(k):
            full = full * _U(BASE) + hashes[j:j + len(full)]
        full = mix(full)
    keep = np.maximum(counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    # Runs that do not cross a row, in order.
    row = np.repeat(np.arange(len(counts)), keep)
    place = first[:-1][row] + (np.arange(out[-1]) - out[row])
    short = counts[row] < k
    got = np.empty(out[-1], np.uint64)
    got[~short] = full[place[~short]]
    for i in np.flatnonzero(short):
        h = np.array([counts[row[i]]], np.uint64)
        for x in hashes[first[row[i]]:first[row[i] + 1]]:
            h = h * _U(BASE) + x
        got[i] = mix(h)[0]
    return got, out


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of flat ``values``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))

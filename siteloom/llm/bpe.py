"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a leaf row of a segment tree whose leaf i holds the rank of the pair that
starts at symbol i; the root is the leftmost lowest rank, so each merge is one look at
the root and three leaf updates of logarithmic depth. The trees of all new words of a
batch stand side by side in one matrix and step together. The rank table is read once
from a tokenizer file and sent to the tasks: its size is that of the vocabulary.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated
rows and further columns pass through; ids outside the vocabulary are skipped on decoding;
texts are valid UTF-8; decoded bytes that are not become U+FFFD. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import block, chunks, lists, mix, octets, small_batches

#: Fixed value: the pattern that cuts text into words before merging.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words kept by a worker; the table is dropped and refilled beyond it.
CACHE_WORDS = 400_000
#: Bytes of text that are encoded and decoded at a time: some thirty tables of up to eight times their size stand beside them.
TEXT_BYTES = 1 << 19
#: Cells of the tree matrix worked on at a time.
CELLS = 1 << 18
_NONE = np.int64(1) << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_tables(path: str) -> dict:
    """Plain arrays of a byte-level BPE tokenizer file: merges, byte ids, token bytes, added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    vocab, letters = model["vocab"], byte_letters()
    back = {c: b for b, c in letters.items()}
    added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    tokens = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: c.encode() for c, i in added}
    size = max(tokens) + 1
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    key = (left << 32) | right
    order = np.argsort(key)
    return {
        "keys": key[order], "ranks": order.astype(np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int64),
        "bytes": np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64),
        "tokens": [tokens.get(i, b"") for i in range(size)], "added": added,
    }


def letter_classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 0 other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for value, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return out


def cut_words(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start flags of the words of :data:`WORD` in rows of code points that begin at ``first``.

    Runs of one class are words. The last white space before other text stands alone, and if it is
    a blank it opens the next word. An apostrophe that opens a word takes a known ending with it.
    """
    n = len(code)
    kind = classes[code]
    fresh = np.zeros(n + 4, bool)
    fresh[first] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    same = ~fresh[1:n]  # position i + 1 is in the row of i
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & same)
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    mark = np.flatnonzero(start[:n] & (code == 39))
    padded = np.concatenate([code, np.zeros(3, code.dtype)])
    one, two = padded[mark + 1], padded[mark + 2]
    near, far = ~fresh[mark + 1] & (mark + 1 < n), ~fresh[mark + 2] & (mark + 2 < n)
    short = near & np.isin(one, [ord(c) for c in "stmd"])
    long = near & far & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    return start[:n]


class Encoder:
    """Encodes chunks of bytes; words met before are looked up by their bytes.

    A word of up to ``SHORT`` bytes is two numbers of eight bytes and its length; a table of ``SLOTS`` places holds these, so
    a hit is an equal word. Longer words are kept in a dictionary.
    """

    SLOTS, SHORT = 1 << 20, 16

    def __init__(self, tables: dict):
        self.t = tables
        self.classes = letter_classes()
        self.added = sorted(((c.encode(), i) for c, i in tables["added"]), key=lambda x: -len(x[0]))
        self.cut = regex.compile(b"|".join(regex.escape(c) for c, _ in self.added)) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.slot_low, self.slot_high = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.slot_size = np.zeros(self.SLOTS, np.int64)
        self.long: dict[bytes, int] = {}
        self.slot_word = np.zeros(self.SLOTS, np.int64)
        # Word 0 is the empty word; added tokens are the words after it.
        self.begin, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.learn([np.array([i], np.int32).tobytes() for _, i in self.added])

    def learn(self, packed: list[bytes]) -> int:
        """Keep the ids of new words; returns the number of the first."""
        base = len(self.begin)
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(packed), np.int32)])
        return base

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows whose bytes are raw[at[i]:at[i + 1]]: flat ids and row offsets."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        whole = raw.tobytes()
        code = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_of = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(byte_of, at)
        # Added tokens are cut out first; each one and the text after it act as rows of their own.
        marks = [(m.start(), m.end(), m.group()) for m in self.cut.finditer(whole)] if self.cut and any(c in whole for c, _ in self.added) else []
        if marks:
            row = np.searchsorted(at, [m[0] for m in marks], side="right")
            marks = [m for m, r in zip(marks, row) if m[1] <= at[r]]
        spots = np.array([p for m in marks for p in m[:2]], np.int64)
        cuts = np.unique(np.concatenate([first, np.searchsorted(byte_of, spots)]))
        start = np.flatnonzero(cut_words(code, cuts[cuts < len(code)], self.classes))
        begin = byte_of[start]
        if marks:
            # Starts inside an added token go.
            inside = np.zeros(len(raw) + 1, np.int32)
            np.add.at(inside, spots[0::2] + 1, 1)
            np.add.at(inside, spots[1::2], -1)
            begin = begin[np.cumsum(inside)[begin] == 0]
        end = np.append(begin[1:], len(raw))
        eight, width = octets(raw), end - begin
        low, high = block(eight, begin, width), block(eight, begin + 8, width - 8)
        slot = (mix(low ^ mix(high + width.astype(np.uint64))) >> np.uint64(44)).astype(np.int64)
        word = self.slot_word[slot]
        known = (self.slot_low[slot] == low) & (self.slot_high[slot] == high) & (self.slot_size[slot] == width) & (width <= self.SHORT)
        if marks:
            which = np.searchsorted(begin, spots[0::2])
            number = {c: i + 1 for i, (c, _) in enumerate(self.added)}
            word[which] = [number[m[2]] for m in marks]
            known[which] = True
        miss = np.flatnonzero(~known)
        if len(miss):
            fresh: dict[bytes, int] = {}
            base = len(self.begin)
            for i, a, b in zip(miss.tolist(), begin[miss].tolist(), end[miss].tolist()):
                w = whole[a:b]
                old = self.long.get(w) if b - a > self.SHORT else None
                word[i] = base + fresh.setdefault(w, len(fresh)) if old is None else old
            if fresh:
                self.learn(self.encode_words(list(fresh)))
                self.long.update((w, base + i) for w, i in fresh.items() if len(w) > self.SHORT)
            put = miss[width[miss] <= self.SHORT]
            at_slot = slot[put]
            self.slot_low[at_slot], self.slot_high[at_slot], self.slot_size[at_slot], self.slot_word[at_slot] = low[put], high[put], width[put], word[put]
        size = self.length[word]
        stop = np.cumsum(size)
        ids = self.pool[np.arange(stop[-1]) + np.repeat(self.begin[word] - (stop - size), size)]
        row_at = np.concatenate([[0], stop])[np.searchsorted(begin, at)]
        if len(self.begin) > CACHE_WORDS:
            self.forget()
        return ids, row_at

    def encode_words(self, raw: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in raw], np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        out: list[bytes] = [b""] * len(raw)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            step = max(1, CELLS // int(w))
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part], int(w))):
                    out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.t["keys"], key), len(self.t["keys"]) - 1)
        return np.where(self.t["keys"][at] == key, self.t["ranks"][at], _NONE)

    def _merge(self, group: list[bytes], size: int) -> list[bytes]:
        n = len(group)
        lens = np.array([len(g) for g in group], np.int64)
        inside = np.arange(size) < lens[:, None]
        ids = np.full((n, size), -1, np.int64)
        ids[inside] = self.t["bytes"][np.frombuffer(b"".join(group), np.uint8)]
        if not len(self.t["keys"]):
            return [row[row >= 0].astype(np.int32).tobytes() for row in ids]
        tree = np.full((n, 2 * size), _NONE, np.int64)
        rank = self._rank(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
        rank[~inside[:, 1:]] = _NONE
        at = np.arange(size - 1)
        tree[:, size:2 * size - 1] = np.where(rank == _NONE, _NONE, rank * size + at)
        half = size
        while half > 1:
            pairs = tree[:, half:2 * half].reshape(n, half // 2, 2)
            tree[:, half // 2:half] = pairs.min(axis=2)
            half //= 2
        after = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()
        after[np.arange(n), lens - 1] = size
        before = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
        flat_tree, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()

        def put(row, leaf, value):
            node = leaf + size
            base = row * (2 * size)
            flat_tree[base + node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                flat_tree[base + node] = np.minimum(flat_tree[base + 2 * node], flat_tree[base + 2 * node + 1])

        def score(row, i, j):
            """Leaf value of the pair (i, j); none where j lies beyond the word."""
            ok = j < size
            r = self._rank(flat_ids[row * size + i], flat_ids[row * size + np.where(ok, j, i)])
            return np.where(ok & (r != _NONE), r * size + i, _NONE)

        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = flat_tree[row * (2 * size) + 1]
            i, r = root % size, root // size
            base = row * size
            j = flat_after[base + i]
            k = flat_after[base + j]
            flat_ids[base + i] = self.t["merged"][r]
            flat_ids[base + j] = -1
            flat_after[base + i] = k
            has = k < size
            flat_before[(base + k)[has]] = i[has]
            put(row, j, np.full(len(row), _NONE))
            put(row, i, score(row, i, k))
            p = flat_before[base + i]
            has = p >= 0
            if has.any():
                put(row[has], p[has], score(row[has], p[has], i[has]))
            row = row[flat_tree[row * (2 * size) + 1] != _NONE]
        kept = ids >= 0
        cuts = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]) * 4
        packed = ids[kept].astype(np.int32).tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _spread(df: DataFrame, out: str, kind: T.DataType) -> T.StructType:
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    return T.StructType([*df.schema.fields, T.StructField(out, kind)])


def _encoded(batches: Iterator[pa.RecordBatch], tables: dict, text: str, out: str) -> Iterator[pa.RecordBatch]:
    """Batches with the token ids of ``text``, cut in runs of about TEXT_BYTES."""
    encoder = Encoder(tables)
    for batch in batches:
        for lo, hi, raw, at in chunks(batch, text, TEXT_BYTES):
            ids, row_at = encoder.encode(raw, at)
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, lists(ids, row_at, pa.int32())], names=[*batch.schema.names, out])


def _decoded(batches: Iterator[pa.RecordBatch], tables: dict, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    """Batches with the text of the token ids."""
    tokens = tables["tokens"]
    length = np.array([len(t) for t in tokens], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    pool = np.frombuffer(b"".join(tokens), np.uint8)
    for batch in batches:
        column = batch.column(ids)
        at = np.concatenate([[0], np.cumsum(np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64))])
        got = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        good = (got >= 0) & (got < len(tokens))
        got = np.where(good, got, 0)
        size = np.where(good, length[got], 0)
        end = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(end[-1]) + np.repeat(begin[got] - end[:-1], size)
        joined = pool[place].tobytes()
        cut = end[at]
        texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of ``text`` as array<int>; all other columns stay."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer_path))
    return small_batches(df).mapInArrow(lambda batches: _encoded(batches, tables.value, text, out), _spread(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the token ids; a null list gives the empty text."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer_path))
    return small_batches(df).mapInArrow(lambda batches: _decoded(batches, tables.value, ids, out), _spread(df, out, T.StringType()))


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, without ``text``: a task then holds one Python worker, not two."""
    tables = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer_path))
    rest = df.drop(text)

    def run(batches):
        for batch in _decoded(_encoded(batches, tables.value, text, ids), tables.value, ids, out):
            yield batch.drop_columns([text])

    kinds = [*rest.schema.fields, *_spread(rest, ids, T.ArrayType(T.IntegerType())).fields[-1:], *_spread(rest, out, T.StringType()).fields[-1:]]
    return small_batches(df).mapInArrow(run, T.StructType(kinds))

"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by shares of
its characters, word shape and repetition, and by character trigrams hashed to sums with fixed
signs. Gated attention (a tanh branch times a sigmoid branch) weighs the passages, the weighted
mean is scored by a logistic unit, and all weights are learned from document labels alone.

The model is fitted on at most ``SAMPLE`` labelled documents, taken in the order of a hash of the
id, so the sample does not depend on the layout of the files. Scoring covers every passage of
every whole text.

Defined cases: a null, empty or wordless text is one passage of zeros and gets the score of that;
without any label, or with one class alone, every score is the share of label 1 (0.5 without labels);
labels that are null are not used, repeated label rows count once by their mean; documents
without a label are scored like the others. A null id has the remainder of the text "". Extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, TAB, chunks, materialise, mix, prefix_hash, small_batches, span_hash, words

PASSAGE = 100
SAMPLE = 4000
HASHED, SHAPE = 16, 16
WIDTH = HASHED + SHAPE
HIDDEN = 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4

_WORD = np.ones(256, bool)
_WORD[[*range(9, 14), 32]] = False


#: Byte classes whose shares describe a passage: upper, lower, digits, marks, !?, table and code signs, beyond ASCII, line ends.
CLASSES = [[(65, 90)], [(97, 122)], [(48, 57)], [(44, 44), (46, 46), (58, 59)], [(33, 33), (63, 63)],
           [(35, 43), (60, 62), (64, 64), (91, 96), (123, 126)], [(128, 255)], [(10, 10)]]
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _number, _ranges in enumerate(CLASSES):
    for _a, _b in _ranges:
        CLASS_OF[_a:_b + 1] = _number


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the rows, and passages before each row (n + 1); at least one per row."""
    start, end, first = words(raw, at, _WORD)
    count = np.diff(first)
    per_row = np.maximum(1, -(-count // PASSAGE))
    row_at = np.concatenate([[0], np.cumsum(per_row)])
    n = int(row_at[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not len(start):
        return out, row_at
    owner = np.repeat(np.arange(len(count)), count)
    passage = row_at[owner] + (np.arange(len(start)) - first[owner]) // PASSAGE
    head = np.flatnonzero(np.diff(np.concatenate([[-1], passage])))
    ids = passage[head]
    lo = start[head]
    # Bytes from a passage's first word to the next passage; each is of one class.
    of_byte = np.repeat(ids, np.diff(np.append(lo, len(raw))))
    body = raw[lo[0]:]
    shares = np.bincount(of_byte * 16 + CLASS_OF[body], minlength=n * 16).reshape(n, 16)
    out[:, :len(CLASSES)] = shares[:, :len(CLASSES)] / np.maximum(shares.sum(axis=1, keepdims=True), 1)
    size = shares.sum(axis=1)[ids].astype(np.float32)
    length = (end - start).astype(np.float32)
    words_in = np.diff(np.append(head, len(start))).astype(np.float32)
    out[ids, 8] = np.add.reduceat(length, head) / words_in / 10
    out[ids, 9] = np.sqrt(np.add.reduceat(length * length, head) / words_in) / 10
    lower = LOWER[raw]
    h = span_hash(prefix_hash(lower), start, end)
    # Repetition: share of words that are not the first of their kind in the passage, and in the document.
    for column, group in ((10, passage), (11, owner)):
        key = mix(h ^ mix(group.astype(np.uint64) + np.uint64(1)))
        _, where = np.unique(key, return_index=True)
        again = np.ones(len(h), np.float32)
        again[where] = 0
        out[ids, column] = np.add.reduceat(again, head) / words_in
    out[ids, 12] = np.add.reduceat((length <= 3).astype(np.float32), head) / words_in
    out[ids, 13] = np.add.reduceat((length > 14).astype(np.float32), head) / words_in
    out[ids, 14] = np.minimum(words_in / PASSAGE, 1)
    out[ids, 15] = np.minimum(np.log1p(count[owner[head]]) / 10, 1)
    # Hashed trigrams: each adds +1 or -1 to one of HASHED sums.
    if len(lower) >= 3:
        t = TAB[lower]
        tri = mix(t[:-2] + (t[1:-1] << np.uint64(1)) + (t[2:] << np.uint64(2)))
        # A trigram belongs to the passage of its first byte.
        spot, sign = (tri >> np.uint64(60)).astype(np.int64), np.where(tri & np.uint64(1), 1.0, -1.0)
        sums = np.bincount(of_byte[:max(0, len(tri) - lo[0])] * HASHED + spot[lo[0]:], weights=sign[lo[0]:], minlength=n * HASHED)
        out[ids, SHAPE:] = sums.reshape(n, HASHED)[ids] / size[:, None] * 4
    return out, row_at


class Model:
    """Gated attention over passage features; ``p`` holds the weights."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def forward(self, x: np.ndarray, row_at: np.ndarray):
        p, heads = self.p, row_at[:-1]
        rows = np.repeat(np.arange(len(heads)), np.diff(row_at))
        z = (x - p["mean"]) / p["scale"]
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, heads)[rows])
        a = s / np.add.reduceat(s, heads)[rows]
        bag = np.add.reduceat(a[:, None] * h, heads)
        y = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["b"], -30, 30)))
        return rows, z, h, v, u, a, bag, y

    def score(self, x, row_at):
        return self.forward(x, row_at)[-1]


def fit(x: np.ndarray, row_at: np.ndarray, y: np.ndarray, seed: int = 5) -> Model | float:
    """Fit on bags; the share of label 1 where there is nothing to learn."""
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3,
         "E": rng.normal(0, WIDTH ** -0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, HIDDEN)),
         "w": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b": np.zeros(())}
    model, learned = Model(p), ["E", "e", "V", "U", "w", "c", "b"]
    one, two, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo:lo + BATCH]
            size = row_at[pick + 1] - row_at[pick]
            at = np.concatenate([[0], np.cumsum(size)])
            part = x[np.arange(at[-1]) + np.repeat(row_at[pick] - at[:-1], size)]
            rows, z, h, v, u, a, bag, got = model.forward(part, at)
            d = (got - y[pick]) / len(pick)
            g = {"c": bag.T @ d, "b": d.sum()}
            d_bag = d[:, None] * p["c"]
            d_a = (d_bag[rows] * h).sum(axis=1)
            d_s = a * (d_a - np.add.reduceat(a * d_a, at[:-1])[rows])
            g["w"] = (v * u).T @ d_s
            d_v, d_u = d_s[:, None] * p["w"] * u * (1 - v * v), d_s[:, None] * p["w"] * v * u * (1 - u)
            g["V"], g["U"] = h.T @ d_v, h.T @ d_u
            d_h = (a[:, None] * d_bag[rows] + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
            g["E"], g["e"] = z.T @ d_h, d_h.sum(axis=0)
            step += 1
            for k in learned:
                grad = g[k] + DECAY * p[k]
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(id_col: str) -> Column:
    """Documents that labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | float:
    """Fit on at most ``sample`` labelled documents outside the held-out part."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(label).alias("y"))
    marks = marks.where(~held_out(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    bags = materialise(docs.select(id_col, F.col(text).alias("text")).join(marks, id_col).select("y", "text"), "labelled")

    def run(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "text"):
                x, row_at = passages(raw, at)
                data = [x[a:b].tobytes() for a, b in zip(row_at[:-1], row_at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array(data, pa.binary())], names=["y", "x"])

    # The sample is bounded; rows are put in a fixed order, so the fit does not depend on partitions.
    got = sorted((r["y"], bytes(r["x"])) for r in small_batches(bags).mapInArrow(run, "y double, x binary").collect())
    parts = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, x in got]
    row_at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *parts]).astype(np.float64)
    return fit(x, row_at, np.array([float(y >= 0.5) for y, _ in got]))


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1; all columns stay."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists already")

    def run(batches):
        for batch in batches:
            parts = [np.full(hi - lo, model) if isinstance(model, float) else model.score(*passages(raw, at)) for lo, hi, raw, at in chunks(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], names=[*batch.schema.names, out])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))

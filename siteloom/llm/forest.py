"""Nearest neighbours by a forest of sorted hash strings.

Each tree hashes a vector to a string of ``BITS`` bits by random hyperplanes of its own and keeps
the strings sorted, so that the rows sharing a prefix are one slice. A query descends to its longest
prefix match in any tree and ascends all trees together, one bit at a time. At depth x a row at
angle a is missed by all trees with probability (1 - (1 - a / pi) ** x) ** TREES; a query stops as
soon as that is at most ``MISS`` for a row as near as its k-th best. The rule reads nothing from
the size of the data, holds for clustered and for scattered vectors, and at depth 0 has seen every row.

Largest inner products become smallest angles by one more coordinate, sqrt(M ** 2 - |v| ** 2)
for rows and 0 for queries, M being the largest norm.

Rows are dealt to blocks of ``BLOCK`` rows, each with a forest of its own, and queries to blocks of ``ASKED``;
every block of queries meets every block of rows, and the k best of all blocks are kept. Both
sides of a task are so bounded, whatever the number of equal vectors.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, as rows or queries; ties go to the smaller id; a query is no
candidate of its own, also where its id is repeated; fewer than k candidates are all
returned. A null id takes no part. Extra columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TREES, BITS = 32, 30
MISS = 0.1
#: Rows, as a multiple of k and with repeats over the trees, that the first look asks for.
OFFER = 8
BLOCK, ASKED = 8192, 1024


def usable(vec: Column) -> Column:
    """Vectors with finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vec) > 0) & F.exists(vec, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one block of rows (augmented vectors)."""

    def __init__(self, rows: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(TREES * BITS, rows.shape[1]))
        codes = self.codes(rows)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, vecs: np.ndarray) -> np.ndarray:
        """One integer per tree and vector."""
        bits = (vecs @ self.planes.T > 0).reshape(len(vecs), TREES, BITS)
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.ascontiguousarray((bits @ weight).T)

    def slices(self, codes: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the tree that share ``depth`` bits with each code: from, to."""
        low = (codes >> (BITS - depth)) << (BITS - depth)
        return np.searchsorted(self.sorted[tree], low), np.searchsorted(self.sorted[tree], low + (1 << (BITS - depth)))


def search(rows: np.ndarray, row_ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a block for each query: ids (-1: none) and scores, best first.

    The levels of an ascent hold each other, so only two are scored: the one of the longest
    matches that offer enough rows, and the one that its k-th best asks for.
    """
    by_id = np.argsort(row_ids, kind="stable")
    rows, row_ids, n = rows[by_id], row_ids[by_id], len(asked)
    extra = np.sqrt(np.maximum(top * top - (rows * rows).sum(axis=1), 0))
    forest = Forest(np.column_stack([rows, extra]))
    codes = forest.codes(np.column_stack([asked, np.zeros(n)]))
    length = np.sqrt((asked * asked).sum(axis=1))
    # Descent: the deepest level whose slices offer some multiple of k.
    depth = np.zeros(n, np.int64)
    for x in range(1, BITS + 1):
        offered = sum(np.subtract(*forest.slices(codes[t], t, x)[::-1]) for t in range(TREES))
        enough = offered >= OFFER * k
        if not enough.any():
            break
        depth[enough] = x
    found_id, found = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    while True:
        for x in np.unique(depth[depth >= 0]):
            who = np.flatnonzero(depth == x)
            found_id[who], found[who] = _level(forest, rows, row_ids, asked[who], asked_ids[who], codes[:, who], int(x), k)
        cos = np.clip(found[:, -1] / np.maximum(top * length, 1e-300), -1, 1)
        share = 1 - np.arccos(cos) / math.pi
        # The deepest level at which rows as near as the k-th best are missed rarely enough.
        with np.errstate(divide="ignore", invalid="ignore"):
            goal = np.floor(np.log(1 - MISS ** (1 / TREES)) / np.log(share))
        goal = np.where(share >= 1, BITS, np.where(share <= 0, 0, np.nan_to_num(goal))).astype(np.int64)
        depth = np.where((depth >= 0) & (goal < depth), np.maximum(goal, 0), -1)
        if (depth < 0).all():
            return found_id, found


def _level(forest, rows, row_ids, asked, asked_ids, codes, depth, k) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows that share ``depth`` bits with the query in some tree."""
    n, trees = len(asked), TREES if depth else 1
    place = np.full((n, trees, k), -1, np.int64)
    for t in range(trees):
        lo, hi = forest.slices(codes[t], t, depth)
        order = np.argsort(lo, kind="stable")
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(hi > lo, lo, -1)[order]])))
        # Queries of one slice are scored together; empty slices are left out.
        for group in np.split(order, cuts[cuts > 0]):
            group = group[hi[group] > lo[group]]
            if not len(group):
                continue
            at = np.sort(forest.order[t][lo[group[0]]:hi[group[0]]])
            scores = asked[group] @ rows[at].T
            scores[asked_ids[group][:, None] == row_ids[at][None, :]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            kept = np.where(np.isneginf(np.take_along_axis(scores, best, axis=1)), -1, at[best])
            place[group, t, :kept.shape[1]] = kept
    place = np.sort(place.reshape(n, trees * k), axis=1)
    place[:, 1:][place[:, 1:] == place[:, :-1]] = -1
    score = np.full(place.shape, -np.inf)
    for lo in range(0, n, 64):
        part = place[lo:lo + 64]
        exact = np.einsum("qd,qcd->qc", asked[lo:lo + 64], rows[np.maximum(part, 0)])
        score[lo:lo + 64] = np.where(part >= 0, exact, -np.inf)
    ids = np.where(place >= 0, row_ids[np.maximum(place, 0)], -1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
    return ids, score


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for each query: query_id, rank, vec_id, score."""
    def clean(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
                .where(usable(F.col("vec")) & F.col("id").isNotNull()))

    data = materialise(clean(rows), "vectors")
    shape = data.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))")).alias("top"))
    lead = shape.orderBy(F.desc("n"), "size").limit(1).collect()
    if not lead:
        return data.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    size, n, top = lead[0]
    data = data.where(F.size("vec") == size)
    asked = materialise(clean(queries).where(F.size("vec") == size).distinct(), "asked")
    blocks = -(-n // BLOCK)
    groups = max(1, -(-asked.count() // ASKED))
    # Each side is dealt by a hash of its id and meets every block of the other.
    deal = data.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks))).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = asked.withColumn("ask", F.pmod(F.xxhash64("id", "vec"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, scores = search(np.stack(left["vec"].to_numpy()), left["id"].to_numpy(), np.stack(right["vec"].to_numpy()), right["id"].to_numpy(), k, top)
        who = np.repeat(right["id"].to_numpy(), k)
        keep = ids.ravel() >= 0
        return pd.DataFrame({"query_id": who[keep], "vec_id": ids.ravel()[keep], "score": scores.ravel()[keep]})

    found = deal.groupBy("block", "ask").cogroup(asks.groupBy("block", "ask")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Exact top-k search by inner product with MaxScore over sharded postings.

Components are the terms of a sparse query.  The rows of a shard are in the order of falling norm, in blocks, so that
the heap's worst score theta rises early.  For one query and one block, the upper
bound of term d is the larger of 0, q_d * max_d and q_d * min_d over the block's
postings.  A block whose bounds sum to less than theta is passed over.  In others, terms are ordered by falling bound; the
longest tail of terms whose bounds sum to less than theta is non-essential: a vector
found in none of the other, essential, postings cannot enter the heap.  Essential
postings are traversed, which accumulates partial scores (the posting list of a term that most rows have is
its column, taken with the other such columns at once); non-essential terms
are then probed one slice at a time, and only for the vectors whose partial score
plus the bounds still to come reaches theta.  Shards are merged at the end.

Vectors are dealt to shards by a hash of the id and queries to blocks; every pair of
block and shard is one group of at most about ``shard_rows`` and ``block_rows`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._common import cut

SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
SLICE = 8


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double; null unless all components are finite."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(doubles, lambda x: F.floor(F.lit(scale) * x)))


class Shard:
    """Postings of one shard by block: for each term the rows with a non-zero component, their values, and their range."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, block: int = 1024):
        order = np.lexsort((ids, -np.square(matrix.astype(float)).sum(axis=1)))
        self.ids, matrix = ids[order], matrix[order]
        self.unique = len(np.unique(ids)) == len(ids)
        # Whole numbers below 2^53 are exact as doubles, whose products are fast.
        self.most = float(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
        self.blocks = []
        for s in range(0, len(matrix), block):
            part = matrix[s : s + block]
            columns = np.ascontiguousarray(part.T)
            dense = 2 * (part != 0).sum(axis=0) > len(part)
            lists = {int(d): np.flatnonzero(columns[d]) for d in np.flatnonzero(~dense)}
            self.blocks.append((self.ids[s : s + block], columns, columns.astype(float), dense, lists, np.maximum(part.max(axis=0), 0), np.minimum(part.min(axis=0), 0)))

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best ids, ties to smaller ids; an id of several rows has its best score."""
        exact = self.most * float(np.abs(query).max(initial=0)) < 2.0**53
        asked = query.astype(float) if exact else query
        best: dict[int, int] = {}
        theta = None
        for ids, whole, real, dense, lists, high, low in self.blocks:
            bound = np.maximum(query * high, query * low)
            order = np.argsort(-bound, kind="stable")
            tails = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
            if theta is not None and tails[0] < theta:
                continue
            columns = real if exact else whole
            at = len(order) if theta is None else int(np.searchsorted(-tails, -theta, "right"))
            at = min(at, len(order))
            essential = order[:at]
            wide = essential[dense[essential]]
            score = asked[wide] @ columns[wide]
            # Vectors in no essential posting can't reach theta once the tail is below it.
            rows = None if len(wide) or theta is None or tails[at] >= theta else np.zeros(len(ids), bool)
            for d in essential[~dense[essential]].tolist():
                if asked[d]:
                    p = lists[d]
                    score[p] += asked[d] * columns[d, p]
                    if rows is not None:
                        rows[p] = True
            rows = np.arange(len(ids)) if rows is None else np.flatnonzero(rows)
            score = score[rows]
            while at < len(order) and len(rows):
                keep = score + tails[at] >= theta
                rows, score = rows[keep], score[keep]
                probe = order[at : at + SLICE]
                score = score + asked[probe] @ columns[probe[:, None], rows[None, :]]
                at += SLICE
            keep = ids[rows] != own
            if theta is not None:
                keep &= score >= theta
            rows, score = rows[keep], score[keep]
            if self.unique and len(score) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[keep], score[keep]
            for value, i in zip(score.tolist(), ids[rows].tolist(), strict=True):
                best[i] = max(int(value), best.get(i, int(value)))
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            best = dict(top)
            if len(top) == k:
                theta = top[-1][1]
        return [(value, i) for i, value in best.items()]


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = int(vectors.map(len).max()) if len(vectors) else 0
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank from 1, id, score: the k highest integer inner products of each query.

    Rows with a null id, a null vector, or null or non-finite components take no part.
    Rows that share an id with a query are that query's own; a repeated row (equal
    id and vector) counts once.  An id with several vectors is one query and one candidate: a pair of ids has the highest
    score of their vectors, and each id at most one place in a ranking.  Shorter vectors count as
    padded with zeros.  With no queries or no candidates there are no rows.
    """
    ready = cut(
        vectors.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("is_query"))
        .where("id is not null and v is not null")
        .distinct(),
        "vectors",
    )
    counts = ready.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    shards, blocks = -(-max(1, counts["n"]) // shard_rows), -(-max(1, counts["q"]) // block_rows)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ready.where("is_query").select("id", "v", deal(blocks).alias("block"), every(shards).alias("shard"))
    right = ready.select("id", "v", every(blocks).alias("block"), deal(shards).alias("shard"))

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(candidates):
            width = max(int(x["v"].map(len).max()) for x in (queries, candidates))
            matrix, asked = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in map(_matrix, (candidates["v"], queries["v"])))
            shard = Shard(candidates["id"].to_numpy(), matrix)
            for own, q in zip(queries["id"].tolist(), asked, strict=True):
                rows += [(own, i, s) for s, i in shard.search(q, own, k)]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype("int64")

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")

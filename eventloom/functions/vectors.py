"""Vector and sequence expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


BLOCK = 4096  # rows, and queries, of a block


def in_blocks(df: DataFrame, queries: DataFrame, best, shape: T.StructType) -> DataFrame:
    """best(rows, queries) of each block of df(id, ...) with each block of queries(query_id, ...), as rows of shape. Blocks
    are dealt by the hash of the id, and their number follows the row counts, so a task holds one block of each."""
    n, nq = df.count(), queries.count()
    blocks, q_blocks = max(8, -(-n // BLOCK)), max(1, -(-nq // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda key, m: F.pmod(F.xxhash64(key, "x"), F.lit(m)).cast("int")
    d = df.withColumn("block", deal("id", blocks)).withColumn("q_block", every(q_blocks))
    q = queries.withColumn("q_block", deal("query_id", q_blocks)).withColumn("block", every(blocks))
    return d.groupBy("block", "q_block").cogroup(q.groupBy("block", "q_block")).applyInPandas(best, shape)


def best_of_chunk(score, names, ids, k: int):
    """Rows and columns of the k highest finite scores of each row, ties by the order of the columns."""
    import numpy as np

    least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[kept], col[kept]
    return pd.DataFrame({"query_id": names[row], "id": ids[col], "score": score[row, col]})


def _matrix(xs):
    """Arrays as the rows of a matrix; a null and what is missing at the end are zero."""
    import numpy as np

    m = np.zeros((len(xs), max((len(v) for v in xs if v is not None), default=0)))
    for i, v in enumerate(xs):
        if v is not None:
            m[i, : len(v)] = v
    return m


def block_topk(df: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, floor: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact top k of df(id, embedding) for queries(query_id, q) by cosine to 9 places, ties by id.

    Both sides are dealt to blocks; a task multiplies the unit vectors of one block of each and keeps k rows a query, so no
    task sees all candidates of a query. skip_self leaves equal ids out; floor is the least score. A null or zero vector
    scores 0. Rows and queries without an id are left out; equal ids stay rows of their own.
    """
    d = df.where("id IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("x"))
    q = queries.where("query_id IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("x"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], "id": left["id"][:0], "score": np.zeros(0)})
        left = left.sort_values("id", ignore_index=True)
        both = _matrix([*left["x"], *right["x"]])
        size = np.linalg.norm(both, axis=1, keepdims=True)
        both = np.divide(both, size, out=np.zeros_like(both), where=size > 0)
        of, asked, ids, out = both[: len(left)], both[len(left) :], left["id"].to_numpy(), []
        for lo in range(0, len(right), 256):
            names = right["query_id"].to_numpy()[lo : lo + 256]
            score = np.round(asked[lo : lo + 256] @ of.T, 9)
            if floor is not None:
                score = np.maximum(score, floor)
            if skip_self:
                score[names[:, None] == ids[None, :]] = -np.inf
            out.append(best_of_chunk(score, names, ids, k))
        return pd.concat(out, ignore_index=True)

    shape = q.select("query_id").schema.fields + d.select("id").schema.fields + [T.StructField("score", T.DoubleType())]
    return top_ranks(in_blocks(d, q, best, T.StructType(shape)), k)


def top_ranks(met: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best rows a query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed_topk(df: DataFrame, queries: DataFrame, k: int, max_distance: float) -> DataFrame:
    """(query_id, id, score, rank): top k of df(id, x, h) for queries(query_id, x, h) by 1 - d * d / 2 of the Euclidean distance
    d, to 9 places, ties by id, among rows of another id that share a value of h at one of its places at least and lie
    within max_distance. x are arrays of doubles, h of longs of one length. The work is that of block_topk, and no row is
    made for a pair that does not stay among a block's best."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["query_id"][:0], "id": left["id"][:0], "score": np.zeros(0)})
        left = left.sort_values("id", ignore_index=True)
        both, h, asked_h = _matrix([*left["x"], *right["x"]]), np.stack(left["h"]), np.stack(right["h"])
        size, of, asked = (both**2).sum(axis=1), both[: len(left)], both[len(left) :]
        ids, out = left["id"].to_numpy(), []
        for lo in range(0, len(right), 256):
            names = right["query_id"].to_numpy()[lo : lo + 256]
            far = size[None, : len(left)] + size[len(left) + lo : len(left) + lo + len(names), None] - 2 * (asked[lo : lo + 256] @ of.T)
            met = np.zeros(far.shape, dtype=bool)
            for t in range(h.shape[1]):
                met |= asked_h[lo : lo + 256, t][:, None] == h[None, :, t]
            met &= (far < max_distance**2) & (names[:, None] != ids[None, :])
            out.append(best_of_chunk(np.where(met, np.round(1 - np.maximum(far, 0) / 2, 9), -np.inf), names, ids, k))
        return pd.concat(out, ignore_index=True)

    shape = queries.select("query_id").schema.fields + df.select("id").schema.fields + [T.StructField("score", T.DoubleType())]
    return top_ranks(in_blocks(df, queries, best, T.StructType(shape)), k)


def edit_distance(a: list, b: list) -> int:
    """Edits between two lists, by bit vectors: whether each cell of a column of the table is one more or one less than the
    cell above, for all of the longer list at once, a step for each element of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, last, edits = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0  # the cells that are one more, one less
    for w in b:
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (every & ~(diagonal | up)), up & diagonal
        edits += 1 if right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | (every & ~(diagonal | right)), right & diagonal
    return edits


def word_edits(a: Column, b: Column) -> Column:
    """Word edit distance of two arrays of strings, in Arrow batches."""
    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    return run(a, b)

"""Hard negatives by threshold joins with bounds.

A search asks, for each open window of an anchor, for its best rows with a score in the window. It runs in rounds: a join
finds all pairs at or above each anchor's threshold; windows that are filled, or whose threshold has come down to their
lower end, are answered; for the others the threshold is lowered. Rows and anchors are dealt to blocks, and a task joins a
block of each. It indexes the rows' dimensions, the strongest first, but leaves out of each row those whose norm, times the
largest anchor's, is below the least threshold. It adds up partial scores by posting block, drops what the norms of the
dimensions left cannot lift to the threshold, and completes the pairs that remain, so that all scores are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

ROWS, ANCHORS = 2048, 4096  # about so many in a block
#: Thresholds of the rounds, from a window's lower end (0) to its upper end (1).
LEVELS = (0.5, 0.3, 0.1, 0.0)
STEP = 8  # dimensions of a posting block
AT_ONCE = 256  # anchors of a block joined together
SPARSE = 0.1  # share of live pairs under which they are completed one by one


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of integers as rows; shorter lists end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _left_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from each dimension on, in one more column than x."""
    sums = np.cumsum(x[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([sums, np.zeros((len(x), 1))], axis=1))


class Postings:
    """An index of rows for joins with anchors of norms up to most and thresholds from least on."""

    def __init__(self, rows: np.ndarray, most: float, least: float):
        self.dims = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
        rows = rows[:, self.dims]
        left = _left_norms(rows)
        width = (left[:, :-1] * most * (1 + 1e-9) >= least).sum(1)  # indexed dimensions; the rest cannot reach least alone
        width = np.minimum(-(-width // STEP) * STEP, rows.shape[1])
        self.order = np.argsort(-width, kind="stable")
        self.rows, self.left = rows[self.order], left[self.order]
        width = width[self.order]
        self.blocks = [(lo, self.rows[: int((width > lo).sum()), lo : lo + STEP].T.copy()) for lo in range(0, rows.shape[1], STEP)]

    def join(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's threshold."""
        x = x[:, self.dims]
        left, found = _left_norms(x), []
        need = least - 1e-9 * np.abs(least) - 0.5  # scores are integers
        sums, n = np.zeros((len(x), len(self.rows)), x.dtype), len(self.rows)

        def finish(lo: int, hi: int, at: int) -> None:
            """Complete the pairs of rows lo to hi that can still reach the threshold from dimension at on."""
            i, j = np.nonzero(sums[:, lo:hi] + left[:, at, None] * self.left[None, lo:hi, at] * (1 + 1e-9) >= need[:, None])
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000] + lo
                score = sums[a, b] + np.einsum("ij,ij->i", x[a, at:], self.rows[b, at:])
                ok = score >= least[a]
                found.append((a[ok], b[ok], score[ok]))

        for at, block in self.blocks:
            live = block.shape[1]
            if live < n:
                finish(live, n, at)  # of these rows nothing more is indexed
                n = live
            if not n:
                break
            sums[:, :n] += x[:, at : at + STEP] @ block
            upto = at + len(block)
            if upto < len(self.dims) and np.mean(sums[:, :n] + left[:, upto, None] * self.left[None, :n, upto] >= need[:, None]) < SPARSE:
                finish(0, n, upto)
                n = 0
                break
        if n:
            finish(0, n, len(self.dims))
        a, b, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return a, self.order[b], score


def _best(anchors, rows, same: bool, need: int):
    """Of a block of anchors with their windows and a block of rows: the best need rows of each window, as an Arrow table."""
    import pyarrow as pa

    y, x = _matrix(rows["x"]), _matrix(anchors["x"])
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
    if wide * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < 2**53:
        x, y = x.astype(np.float64), y.astype(np.float64)  # sums of products are exact
    row_y, row_x, label_y, label_x = rows["row"].to_numpy(), anchors["row"].to_numpy(), rows["label"].to_numpy(), anchors["label"].to_numpy()
    ids = rows["id"].combine_chunks()
    by_id = np.argsort(np.argsort(ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), kind="stable"))
    per = anchors["windows"].combine_chunks()
    starts = np.concatenate(([0], np.cumsum(per.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    k, lo, hi = (per.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("k", "least", "hi"))
    out = []
    if len(x) and len(y):
        least = np.minimum.reduceat(lo, starts[:-1])
        index = Postings(y, float(_left_norms(x)[:, 0].max()), float(least.min()))
        for at in range(0, len(x), AT_ONCE):
            a, j, score = index.join(x[at : at + AT_ONCE], least[at : at + AT_ONCE])
            a = a + at
            ok = ((label_x[a] == label_y[j]) == same) & (row_x[a] != row_y[j])
            a, j, score = a[ok], j[ok], score[ok].astype(np.int64)
            n = np.diff(starts)[a]  # each pair, for each window of its anchor
            pair = np.repeat(np.arange(len(a)), n)
            window = np.repeat(starts[a], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            ok = (score[pair] >= lo[window]) & (score[pair] <= hi[window])
            pair, window = pair[ok], window[ok]
            order = np.lexsort((by_id[j[pair]], -score[pair], window))
            pair, window = pair[order], window[order]
            ok = np.arange(len(pair)) - np.searchsorted(window, window) < need
            pair, window = pair[ok], window[ok]
            out.append((row_x[a[pair]], k[window], j[pair], score[pair]))
    row, k, j, score = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"row": pa.array(row, pa.int64()), "k": pa.array(k, pa.int32()), "id": ids.take(pa.array(j, pa.int64())), "score": pa.array(score, pa.int64())})


def _fill(scratch: Scratch, name: str, rows: DataFrame, windows: DataFrame, same: bool, need: int) -> DataFrame:
    """(row, k, id, score, rank): the best need rows in each of windows(row, k, lo, hi), of the anchor's label if same, else
    of other labels; scores fall, ties by id. Lowers the thresholds in rounds until all windows are answered."""
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    deal = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    order = Window.partitionBy("row", "k").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    group = F.col("label") if same else F.lit(0)  # negatives: one group of all rows
    total, open_, answered = rows.count(), windows, []
    for n, level in enumerate(LEVELS):
        # thresholds are whole numbers from lo to hi
        asked = open_.withColumn("least", F.col("lo") + F.ceil((F.col("hi") - F.col("lo")) * F.lit(level)).cast("long"))
        anchors = asked.groupBy("row").agg(F.collect_list(F.struct("k", "least", "hi")).alias("windows")).join(rows, "row").select("row", "label", "x", "windows", group.alias("g"))
        anchors = scratch.keep(anchors, f"{name}_{n}_anchors")
        blocks = lambda t, size, name: t.groupBy("g").agg(F.ceil(F.count("*") / size).alias(name))
        if same:
            sizes = scratch.keep(blocks(anchors, ANCHORS, "n_anchors").join(blocks(rows.withColumn("g", group), ROWS, "n_rows"), "g"), f"{name}_{n}_sizes")
            sized = lambda t: t.join(sizes, "g")
        else:
            counts = {"n_anchors": F.lit(-(-anchors.count() // ANCHORS)), "n_rows": F.lit(-(-total // ROWS))}
            sized = lambda t: t.withColumns(counts)
        left = sized(anchors).withColumn("a", deal("a", F.col("n_anchors"))).withColumn("b", every(F.col("n_rows"))).select("g", "a", "b", "row", "label", "x", "windows")
        right = sized(rows.withColumn("g", group)).withColumn("b", deal("b", F.col("n_rows"))).withColumn("a", every(F.col("n_anchors"))).select("g", "a", "b", "row", "label", "x", "id")
        met = left.groupBy("g", "a", "b").cogroup(right.groupBy("g", "a", "b")).applyInArrow(lambda p, q: _best(p, q, same, need), "row long, k int, id long, score long")
        found = scratch.keep(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need), f"{name}_{n}_found")
        full = found.groupBy("row", "k").agg(F.count("*").alias("n"))
        open_ = asked.join(full, ["row", "k"], "left").where((F.coalesce("n", F.lit(0)) < need) & (F.col("least") > F.col("lo"))).select("row", "k", "lo", "hi")
        open_ = scratch.keep(open_, f"{name}_{n}_open")
        answered.append(found.join(open_.select("row", "k"), ["row", "k"], "left_anti"))
        if open_.isEmpty():
            break
    out = answered[0]
    for more in answered[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For anchors, and each of their best positives: the best negatives whose score is low to high percent of the positive's.

    rows(id long, label int, x array<long>); the score of two rows is the inner product of x, shorter arrays ending in
    zeros. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Higher scores come first,
    ties by smaller id, a null id last. Positives have the anchor's label and are other rows than it (repeated rows, and
    rows with the same id, are rows of their own); negatives have another label. A positive with a negative score has no
    window and returns nothing. Rows with a null label or x take no part; an empty table gives no rows; other columns are
    left out. Scores must fit in a long.

    Anchors are joined with all rows in blocks (about ROWS by ANCHORS): the work grows with anchors times rows, each
    task's with one block of each, whatever the label. Copies of one vector share their scores; a block keeps no more of
    them for a window than it returns.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.where("label IS NOT NULL AND x IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "id", "label", "x", anchors.alias("anchor"))
    rows = scratch.keep(rows, "rows")
    some = rows.where("anchor")
    x = rows.drop("anchor")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    most = rows.agg(F.max(norm)).first()[0] or 0.0
    top = F.greatest(F.lit(0), F.ceil(norm * F.lit(most))).cast("long")
    found = _fill(scratch, "positives", x, some.select("row", F.lit(0).alias("k"), F.lit(0).cast("long").alias("lo"), top.alias("hi")), True, positives)
    found = scratch.keep(found.select("row", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = found.select("row", "k", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"{high} * positive_score div 100").alias("hi")).where("lo <= hi")
    got = _fill(scratch, "negatives", x, windows, False, negatives).select("row", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return got.join(found, ["row", "k"]).join(some.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """rows(id, label, x) of embeddings(vec_id, embedding, label): components become floor(scale * x). Rows with a null label, a null vector or any component that is null or not finite are left out."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").alias("id"), "label", x.alias("x"))

"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, n_words_of, text_of

HASH_DIGITS = 15  # hexadecimal digits of the md5 used: 60 bits
LEVEL_DIGITS = 3  # a histogram has 16 ** LEVEL_DIGITS buckets a source at most
LEVELS = 4  # histograms, each inside the boundary bucket of the one before


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits that depend on the row's id and text alone, so that reruns agree; equal rows share them."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of (source, size): weights repeat over the sources by code point, null last.

    target = min(cap * source_size, level * weight), with the one level at which the targets sum to share of all
    sizes. That is where resharing the excess by weight ends. One row a source, so the windows see few rows.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") - before) / here)
    # the first source in this order whose level fits under its cap sets the level for itself and all after it
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "level"))).over(Window.partitionBy())
    return by.select("source", "source_size", F.least("most", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, level, cut): the rows of a source with h < cut hold about the budget.

    rows: (source, size, h); budgets: (source, level, budget), where level numbers nested budgets (1, 2, ...).
    Each round sums sizes by source and hash bucket inside the boundary bucket found so far, and moves the cut to the
    last bucket edge at or below the budget; the last round takes the nearer edge. Nothing is sorted by row, and what
    is shuffled is at most one row a bucket, source and task.
    """
    state = budgets.select("source", "level", "budget", F.lit(0).cast("long").alias("cut"), F.lit(0.0).alias("below"))
    width = 16**HASH_DIGITS
    for n in range(1, LEVELS + 1):
        inside, width = width, max(1, width // 16**LEVEL_DIGITS)
        state = scratch.keep(state, f"state_{n}")
        # several levels can share a boundary bucket: sum its sizes once
        edges = state.select(F.col("source").alias("s"), F.col("cut").alias("edge")).distinct()
        met = (F.col("source").eqNullSafe(F.col("s"))) & (F.col("h") >= F.col("edge")) & (F.col("h") < F.col("edge") + F.lit(inside))
        hist = rows.join(edges, met).groupBy("s", "edge", F.expr(f"(h - edge) div {width}").alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("s", "edge").orderBy("bucket"))
        hist = hist.withColumn("upto", run.cast("double")).select(F.col("s"), F.col("edge"), "bucket", "size", "upto")
        both = state.join(hist, state.source.eqNullSafe(hist.s) & (state.cut == hist.edge), "left")
        left = F.col("budget") - F.col("below")
        over = F.col("upto") > left
        gap = F.when(over, F.struct(F.col("bucket"), F.col("upto"), F.col("size").cast("double").alias("size")))
        found = both.groupBy("source", "level", "budget", "cut", "below").agg(F.min(gap).alias("g"), F.max("upto").alias("all"))
        at = F.col("g.upto") - F.col("g.size")  # held below the boundary bucket
        if n < LEVELS:
            state = found.select("source", "level", "budget", F.when(F.col("g").isNull(), F.col("cut") + F.lit(inside)).otherwise(F.col("cut") + F.col("g.bucket") * F.lit(width)).cast("long").alias("cut"), (F.col("below") + F.coalesce(at, "all", F.lit(0.0))).alias("below"))
        else:
            nearer = F.col("g.upto") - left < left - at
            state = found.select("source", "level", F.when(F.col("g").isNull(), F.col("cut") + F.lit(inside)).otherwise(F.col("cut") + (F.col("g.bucket") + F.when(nearer, 1).otherwise(0)) * F.lit(width)).cast("long").alias("cut"))
    return state


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_mix_source": F.col("source").cast("string"), "_mix_size": n_words_of(text_of()), "_mix_h": row_hash(F.col("doc_id"), text_of())})


def source_cuts(rows: DataFrame, weights: tuple[float, ...], share: float, cap: int, scratch: Scratch) -> DataFrame:
    """(_mix_of, source_size, target, _mix_cuts) of (source, size, h): one row a source, as a written table, whose size Spark knows
    when it chooses the joins with the documents. A row with hash h is taken as often as there are cuts above h."""
    goals = scratch.keep(source_targets(rows, weights, share, cap), "goals")
    levels = goals.select("source", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("level"), "source_size", "target")
    budgets = levels.select("source", "level", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - (F.col("level") - 1) * F.col("source_size"))).alias("budget"))
    cuts = thresholds(rows, budgets, scratch).groupBy("source").agg(F.array_sort(F.collect_list("cut")).alias("_mix_cuts"))  # cap entries a source
    return scratch.keep(goals.alias("g").join(cuts.alias("c"), F.expr("g.source <=> c.source")).select(F.col("g.source").alias("_mix_of"), "source_size", "target", "_mix_cuts"), "cuts")


def _copies(cap: int) -> Column:
    return sum((F.coalesce((F.col("_mix_h") < F.get("_mix_cuts", F.lit(i))).cast("int"), F.lit(0)) for i in range(cap)), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row; taken: words the mix takes, repeats counted.

    A source's rate is target / source_size, 0 to cap. Its nested budgets are one for each copy: copy c of a row is
    taken if the row's hash lies under the threshold of level c, so a row is taken 0 to cap times, and one taken twice
    is always also taken once. A null text has size 0 and takes 0 words; a null source is a source of its own, last.
    Repeated rows share a hash and go together. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_rows(docs).select("doc_id", F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_h").alias("h")), "rows")
    cuts = source_cuts(rows, weights, share, cap, scratch)
    both = rows.withColumnRenamed("h", "_mix_h").join(cuts, F.expr("source <=> _mix_of")).withColumn("copies", _copies(cap))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: docs with each row as often as mix() takes it, all columns kept; rows without words are left out."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_rows(docs).select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_h").alias("h")), "rows")
    cuts = source_cuts(rows, weights, share, cap, scratch)
    both = _rows(docs).where("_mix_size > 0").join(cuts.select("_mix_of", "_mix_cuts"), F.expr("_mix_source <=> _mix_of")).withColumn("_mix_n", _copies(cap)).where("_mix_n > 0")
    return both.withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns)

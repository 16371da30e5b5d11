"""Running values within keys, where one key may hold most of the rows.

A window by key puts all rows of a key into one task. Here the rows are dealt to even ranges of (key, order), whatever the
keys; each task scans its range; and what a range's first key has gathered in the ranges before is carried into it, one
row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut

PART = "_part"


class Scan:
    """Rows of df in the order of `order` within each of `keys` (nulls are a key, and come first in the order).

    The rows are written once, in their ranges, when the scan is made; what is asked of it stays lazy. Rows that are equal
    in keys and order stand in any order, as in a window.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: DataFrame | None = None):
        self.keys, self.order = keys, order
        if rows is None:
            kept = cut(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rows = kept.repartitionById(parts, PART)  # a task a range; windows by range and key need no other shuffle
        self.rows = rows

    def values(self, number: str | None = None, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, final: str | None = None) -> Scan:
        """The scan with more columns, by name. number: place within the key, from 1. final: whether it is the key's last row. sums: running sum, the row included,
        nulls as 0. lags: value in the row before, null in a key's first. lasts: last value that isn't null, the row included."""
        sums, lags, lasts = sums or {}, lags or {}, lasts or {}
        here = F.struct(*self.order)
        key = {k: f"_k{i}" for i, k in enumerate(self.keys)}
        each = {f"_s{i}": F.sum(c) for i, c in enumerate(sums.values())} | {f"_g{i}": F.max_by(F.struct(c.alias("x")), here) for i, c in enumerate(lags.values())} | {f"_l{i}": F.max_by(c, F.when(c.isNotNull(), here)) for i, c in enumerate(lasts.values())}
        ends = self.rows.groupBy(F.col(PART).alias("_p"), *(F.col(k).alias(v) for k, v in key.items())).agg(F.count("*").alias("_n"), *(c.alias(n) for n, c in each.items()))
        before = Window.partitionBy(*key.values()).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        carried = {n: F.sum(n) if n[1] in "sn" else F.last(n, ignorenulls=n[1] == "l") for n in ["_n", *each]}
        more = {"_m": F.lead(F.lit(True)).over(Window.partitionBy(*key.values()).orderBy("_p"))} if final else {}
        carry = ends.select("_p", *key.values(), *(c.over(before).alias(n) for n, c in carried.items()), *(c.alias(n) for n, c in more.items())).where("_n IS NOT NULL" + (" OR _m" if final else ""))
        same = (F.col(PART) == F.col("_p")) & F.lit(True)
        for k, v in key.items():
            same = same & F.col(k).eqNullSafe(F.col(v))
        w = Window.partitionBy(PART, *self.keys).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        # a carried row a range, that of its first key; with final also that of its last
        out = self.rows.withColumn("_i", F.row_number().over(w)).withColumns({f"_ls{i}": F.sum(c).over(upto) for i, c in enumerate(sums.values())} | {f"_lg{i}": F.lag(c).over(w) for i, c in enumerate(lags.values())} | {f"_ll{i}": F.last(c, ignorenulls=True).over(upto) for i, c in enumerate(lasts.values())} | ({"_e": F.lead(F.lit(True)).over(w)} if final else {}))
        out = out.join(F.broadcast(carry), same, "left")
        new = {number: F.col("_i") + F.coalesce("_n", F.lit(0))} if number else {}
        new |= {final: F.col("_e").isNull() & F.col("_m").isNull()} if final else {}
        new |= {n: F.coalesce(f"_ls{i}", F.lit(0)) + F.coalesce(f"_s{i}", F.lit(0)) for i, n in enumerate(sums)}
        new |= {n: F.when(F.col("_i") == 1, F.col(f"_g{i}.x")).otherwise(F.col(f"_lg{i}")) for i, n in enumerate(lags)}
        new |= {n: F.coalesce(f"_ll{i}", f"_l{i}") for i, n in enumerate(lasts)}
        return Scan(self.rows, self.keys, self.order, out.select(*(self.rows[c] for c in self.rows.columns if c not in new), *(c.alias(n) for n, c in new.items())))

    def result(self) -> DataFrame:
        return self.rows.drop(PART)

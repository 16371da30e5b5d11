"""Running values in even parts against windows; the operators that use them; pairs counted without being made."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.scans import PART, Scan
from eventloom.operators import evaluate, fleet, incidents, normalize


@pytest.fixture(scope="module")
def rows(spark):
    """Nine in ten rows belong to one key; null keys, null times and null values."""
    r = random.Random(4)
    found = [("hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.choice([None, *range(4000)]), i, r.choice([None, 1, 2, 5])) for i in range(6000)]
    return spark.createDataFrame(found, "k string, t int, i int, x int").repartition(7)


def test_scan_equals_windows(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges this small would be put together
    try:
        scan = Scan(rows, ["k"], ["t", "i"])
        got = scan.values(number="n", sums={"s": F.col("x")}, lags={"before": F.col("x")}, lasts={"last": F.col("x")}).values(sums={"s2": F.col("n")}).result()
        w = Window.partitionBy("k").orderBy("t", "i")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = rows.select("*", F.row_number().over(w).alias("n"), F.coalesce(F.sum("x").over(upto), F.lit(0)).alias("s"), F.lag("x").over(w).alias("before"), F.last("x", ignorenulls=True).over(upto).alias("last"))
        want = want.withColumn("s2", F.sum("n").over(upto))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        sizes = [r["count"] for r in scan.rows.groupBy(PART).count().collect()]
        assert len(sizes) > 4 and max(sizes) <= 2 * median(sizes)
        # what each task reads, too: a range is a task
        tasks = [r["count"] for r in scan.rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) <= 2 * median(tasks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Scan(rows.limit(0), ["k"], ["t"]).values(number="n").result().count() == 0


def test_windows_by_range_need_no_more_shuffles(spark, rows):
    plan = Scan(rows, ["k"], ["t", "i"]).values(number="n", sums={"s": F.col("x")}).rows._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Window")[0]
    assert "hashpartitioning(k" not in above.replace("_k0", "")


@pytest.fixture(scope="module")
def mentions(spark):
    r = random.Random(6)
    found = [(f"r{i % 700}", *r.choice([("service", "s0"), ("service", "s0"), ("user", f"u{r.randint(0, 9)}"), (None, None)]), r.randint(0, 60_000)) for i in range(1500)]
    return spark.createDataFrame(sorted(set(found), key=str), "record_id string, kind string, id string, s long").withColumn("at", F.timestamp_seconds("s")).dropDuplicates(["record_id", "kind", "id"])


def test_groups_and_pairs(spark, mentions):
    groups = incidents.group_by_gap(mentions, 120).withColumn("group_id", F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("id", F.lit("")), "group_no"))
    by, want = {}, {}
    for r in sorted(mentions.collect(), key=lambda r: (r["s"], r["record_id"])):
        by.setdefault((r["kind"], r["id"]), []).append((r["s"], r["record_id"]))
    pairs = {}
    for key, found in by.items():
        n = 0
        for i, (s, rec) in enumerate(found):
            n += bool(i) and s - found[i - 1][0] > 120
            want[rec, key] = n
            pairs[key, n] = pairs.get((key, n), 0) + sum(1 for t, _ in found[:i] if s - t <= 120)
    assert {(r["record_id"], (r["kind"], r["id"])): r["group_no"] for r in groups.collect()} == want
    got = {r["group_id"]: r["n_pairs"] for r in incidents.count_pairs(groups, 120).collect()}
    assert got == {f"{k or ''}:{i or ''}:{n}": c for ((k, i), n), c in pairs.items()}
    known = incidents.correlate_pairs(mentions.where("kind IS NOT NULL"), 120).count()
    assert known == sum(c for ((k, _), _), c in pairs.items() if k)
    scored = {r["group_id"]: r["score"] for r in incidents.emit_event_groups(groups, incidents.count_pairs(groups, 120)).collect()}
    assert min(scored.values()) > 0 and max(scored.values()) == 1.0
    assert incidents.group_members(groups).count() == groups.select("group_id", "record_id").distinct().count()


def test_operators_in_order(spark):
    r = random.Random(2)
    runs = [(f"run{i}", r.choice(["x", "x", "x", "y"]), r.choice(["completed", "failed"]), i // 3) for i in range(300)]
    got = evaluate.run_history(spark.createDataFrame(runs, "run_id string, scenario string, status string, started_at int")).collect()
    for name in "xy":
        own = sorted((t, i, s) for i, n, s, t in runs if n == name)
        want = [(i, k, k == len(own), sum(s == "completed" for _, _, s in own[:k]) / k, k > 1 and own[k - 2][2] != s) for k, (_, i, s) in enumerate(own, 1)]
        assert sorted((g["run_id"], g["seq"], g["latest"], g["pass_rate"], g["flip"]) for g in got if g["scenario"] == name) == sorted(want)
    roles = spark.createDataFrame([("s", 1, "active"), ("s", 2, "passive"), ("s", 2, "active"), ("s", 3, "active"), (None, 1, "a"), (None, 2, "b")], "site string, at int, role string")
    assert sorted((str(x["site"]), x["at"], x["from_role"], x["role"]) for x in fleet.failovers(roles).collect()) == [("None", 2, "a", "b"), ("s", 2, "active", "passive"), ("s", 3, "passive", "active")]
    acts = spark.createDataFrame([("s", 0, "train", 1), ("s", 2, "train", 2), ("s", 4, "promote", 3), ("s", 4, "read", 4)], "site string, at int, action string, id int")
    assert [x["id"] for x in fleet.passive_violations(acts, roles).collect()] == [2]
    lines = spark.createDataFrame([("user", "u", "t", f"r{i}", i % 50) for i in range(200)], "kind string, id string, topic string, record_id string, time int")
    assert sorted((x["time"], x["record_id"], x["seq"]) for x in normalize.entity_timeline(lines, lines.limit(0)).collect()) == [(t, rec, k) for k, (t, rec) in enumerate(sorted((i % 50, f"r{i}") for i in range(200)), 1)]

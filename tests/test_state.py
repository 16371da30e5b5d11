"""State that stays small: recent queries that expire, one record for late rows, stores of which only touched parts are written."""

import time

from pyspark.sql import functions as F

from eventloom.operators import search
from eventloom.streaming import streams


def test_state_of_idle_users_expires(spark, tmp_path):
    def batch(rows, want):
        spark.createDataFrame(rows, "user long, q string, ts long").select("user", "q", F.timestamp_seconds("ts").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streams.stream_recent(spark.readStream.schema("user long, q string, ts timestamp").parquet(f"{tmp_path}/in"), 3, ttl_ms=4000)
        q = out.writeStream.foreachBatch(lambda b, n: found.append({r["user"]: r["queries"] for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/ck").outputMode("update").start()
        for _ in range(60):
            time.sleep(0.5)
            if sum(map(bool, found)) == want:
                break
        q.stop()

    found: list = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        batch([(1, " a ", 1), (1, "b", 2), (1, "a", 3), (1, "  ", 4), (2, "x", 5)], 1)
        assert [f for f in found if f] == [{1: ["a", "b"], 2: ["x"]}]
        time.sleep(4.5)
        batch([(1, "c", 9)], 2)
        assert [f for f in found if f][1:] == [{1: ["c"]}]
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_hundred_batches_leave_one_record(spark, tmp_path):
    top = streams.Top(spark, f"{tmp_path}/state")
    assert top.before(0) is None
    for n in range(100):
        top.write(n, None if n == 7 else (n * 37) % 100)
    assert [p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")] == ["top.json"]
    assert top.read() == {"batch": 99, "top": 99, "before": 99} and top.before(100) == 99
    top.write(100, 5000)
    assert top.before(101) == 5000 and top.before(100) == 99  # a batch that runs again sees what it saw
    top.write(100, 5000)
    assert top.before(100) == 99


def test_small_batches_write_touched_parts_only(spark, tmp_path):
    path, files = str(tmp_path / "store"), lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    docs = lambda lo, hi, v, t="text": spark.range(lo, hi).select("id", F.concat(F.lit(t), "id").alias("text"), F.lit(v).alias("version"))
    assert {r["action"] for r in search.ingest_into(docs(0, 500, 1), path, 16).collect()} == {"insert"}
    before = files()
    got = search.ingest_into(docs(7, 9, 2, "new"), path, 16).collect()
    assert sorted(map(tuple, got)) == [(7, "update"), (8, "update")]
    kept = [p for p in files() if p in before]
    assert len(before) - len(kept) <= 2 and len(kept) >= 12
    now = files()
    assert {r["action"] for r in search.ingest_into(docs(0, 500, 1), path, 16).collect()} == {"keep"} and files() == now
    rows = {r["id"]: (r["text"], r["version"]) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 500 and rows[7] == ("new7", 2) and rows[9] == ("text9", 1)

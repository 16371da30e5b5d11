"""Structured Streaming operators (STR-01 to STR-10). Watermarks, windows and triggers are choices; event times are TIMESTAMP."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate
from ..sources import topics


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over all that is there now and write Parquet at path; waits for the end."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_validate(stream: DataFrame, topic: str, good: str, bad: str, checkpoint: str):
    """STR-01. Decode envelopes of a topic, and fork valid and quarantined rows to two folders. A batch that is run again overwrites its own parts."""

    def fork(batch: DataFrame, n: int) -> None:
        rows = topics.decode_cloudevents(batch, topic).persist()
        valid, held = validate.validate(rows, topic)
        valid.write.mode("overwrite").parquet(f"{good}/batch={n}")
        held.write.mode("overwrite").parquet(f"{bad}/batch={n}")
        rows.unpersist()

    q = stream.writeStream.foreachBatch(fork).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_dedupe(stream: DataFrame, time_col: str, delay: str, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """STR-02. Drop repeats of (source, id) within the watermark's delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_counts(stream: DataFrame, time_col: str, width: str, delay: str, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """STR-03. Tumbling counts, emitted once the watermark has passed a window."""
    n = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("bucket"), *by, "n")


def stream_groups(stream: DataFrame, time_col: str, gap: str, delay: str, by: tuple[str, ...] = ("kind", "id")) -> DataFrame:
    """STR-04. Session groups of each entity."""
    s = stream.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("first"), F.col("w.end").alias("closes"), *by, "n")


def stream_rates(stream: DataFrame, baseline: DataFrame, time_col: str, width: str, slide: str, delay: str, factor: float = 2.0) -> DataFrame:
    """STR-05. Sliding counts by source against a static baseline(source, expected); flagged beyond factor times the expected."""
    n = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width, slide).alias("w"), "source").agg(F.count("*").alias("n"))
    return n.join(baseline, "source", "left").select(F.col("w.start").alias("bucket"), "source", "n", "expected", F.coalesce(F.col("n") > factor * F.col("expected"), F.lit(True)).alias("flagged"))


def stream_correlate(alerts: DataFrame, logs: DataFrame, gap: str, delay: str) -> DataFrame:
    """STR-06. Alerts(alert_id, entity, at) with logs(log_id, entity, seen) of the entity within gap on either side."""
    a, b = alerts.withWatermark("at", delay), logs.withWatermark("seen", delay)
    b = b.withColumnRenamed("entity", "log_entity")
    return a.join(b, F.expr(f"entity = log_entity AND seen >= at - INTERVAL {gap} AND seen <= at + INTERVAL {gap}")).drop("log_entity")


def stream_enrich(stream: DataFrame, topology: DataFrame, key: str) -> DataFrame:
    """STR-07. Topology attributes of each row; rows without any stay."""
    return stream.join(topology, key, "left")


def _recent(n: int, ttl_ms: int | None):
    """The state of one user: a list of (q, ts), newest first; what has not been written for ttl_ms is gone."""
    from pyspark.sql.streaming import StatefulProcessor

    class Recent(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getListState("last", "q string, ts long", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            import pandas as pd

            have = {q: t for q, t in self.last.get()} if self.last.exists() else {}
            for pdf in rows:
                for q, ts in zip(pdf["q"], pdf["ts"].astype("datetime64[us]").astype("int64"), strict=True):
                    q = (q or "").strip(" ")
                    if q:
                        have[q] = max(int(ts), have.get(q, int(ts)))
            last = sorted(have.items(), key=lambda x: (-x[1], x[0]))[:n]
            if last:
                self.last.put(last)
            yield pd.DataFrame({"user": [key[0]], "queries": [[q for q, _ in last]]})

        def close(self) -> None:
            pass

    return Recent()


def stream_recent(stream: DataFrame, n: int = 20, ttl_ms: int | None = None) -> DataFrame:
    """STR-08. Of (user, q, ts): each user's last n distinct trimmed queries, newest first, kept as state and emitted when it changes.

    With ttl_ms, the state of a user of whom nothing came for so long goes by itself; such a stream has a batch at every
    trigger, so it runs until it is stopped, not availableNow. The state is kept in RocksDB, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("user").transformWithStateInPandas(_recent(n, ttl_ms), "user long, queries array<string>", "Update", "ProcessingTime" if ttl_ms else "None")


class Top:
    """The greatest event time of a stream's batches: one small file, replaced as a whole by renaming.

    It holds the last batch, the greatest time with it and the one before it, so that a batch that runs again sees what it
    saw the first time.
    """

    def __init__(self, spark, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/top.json")
        self.fs = self.path.getFileSystem(self.conf)

    def read(self) -> dict:
        if not self.fs.exists(self.path):
            return {"batch": -1, "top": None, "before": None}
        found = self.fs.open(self.path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def before(self, batch: int) -> int | None:
        now = self.read()
        return now["before"] if now["batch"] == batch else now["top"]

    def write(self, batch: int, top: int | None) -> None:
        before = self.before(batch)
        new = self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), "top.json.new")
        out = self.fs.create(new, True)
        out.write(json.dumps({"batch": batch, "top": max([x for x in (top, before) if x is not None], default=None), "before": before}).encode())
        out.close()
        replace = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        replace[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").valueOf("OVERWRITE")
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(new, self.path, replace)


def stream_late(stream: DataFrame, time_col: str, delay_s: int, on_time: str, late: str, state: str, checkpoint: str):
    """STR-09. Rows older than the greatest event time of earlier batches less delay_s go to a late table. That time is one small record in the folder state, however many batches have run."""

    def split(batch: DataFrame, n: int) -> None:
        top = Top(batch.sparkSession, state)
        seen = top.before(n)
        rows = batch.persist()
        t = F.unix_micros(F.col(time_col))
        old = F.lit(False) if seen is None else F.coalesce(t < seen - delay_s * 1_000_000, F.lit(False))
        rows.where(~old).write.mode("overwrite").parquet(f"{on_time}/batch={n}")
        rows.where(old).write.mode("overwrite").parquet(f"{late}/batch={n}")
        top.write(n, rows.agg(F.max(t)).first()[0])
        rows.unpersist()

    q = stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_rewards(stream: DataFrame, time_col: str, width: str, delay: str) -> DataFrame:
    """STR-10. Mean reward and number by model and window."""
    r = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), "model").agg(F.avg("reward").alias("reward"), F.count("*").alias("n"))
    return r.select(F.col("w.start").alias("bucket"), "model", "reward", "n")


def run_to_table(df: DataFrame, folder: str, mode: str = "append", sink: Callable | None = None) -> DataFrame:
    """The rows that a stream over the files there now has emitted, read back from Parquet under folder."""
    spark = df.sparkSession
    if mode == "append":
        start(df, f"{folder}/out", f"{folder}/checkpoint")
    else:
        q = df.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")

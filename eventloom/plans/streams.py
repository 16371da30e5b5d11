"""Queries of the streaming operators: the events table as a file stream, run to its end and read back.

Only what the watermark has closed is emitted; the SQL keeps the same windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_folder, remove_at_end
from ..streaming import streams
from . import views as v

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _folder(spark):
    return remove_at_end(spark, new_folder(spark, "stream"))


def _events(spark, sf_dir):
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    if not static.inputFiles()[0].endswith("/events.parquet"):  # a folder of part files is a stream by itself
        return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    # one file is a stream of one file: pathGlobFilter leaves the folder's other tables out
    s = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


LAST = "(SELECT max(ts) FROM events)"


@query("SELECT event_type AS source, user_id AS id, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def str02_dedupe(spark, sf_dir):
    s = _events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), "at")
    return streams.run_to_table(streams.stream_dedupe(s, "at", "365 days"), _folder(spark)).select("source", "id", F.lit(True).alias("seen"))


@query(f"SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, source, n FROM (SELECT date_trunc('hour', ts) AS b, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2) WHERE b + INTERVAL 1 HOUR <= {LAST} - INTERVAL 10 MINUTE")
def str03_counts(spark, sf_dir):
    s = _events(spark, sf_dir).withColumnRenamed("event_type", "source")
    out = streams.run_to_table(streams.stream_counts(s, "at", "1 hour", "10 minutes"), _folder(spark))
    return out.select(v.stamp("bucket").alias("bucket"), "source", "n")


@query(f"""WITH m AS (SELECT user_id AS id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000000 THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m)
  SELECT id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM g GROUP BY id, g HAVING max(ts) + INTERVAL 1 HOUR <= {LAST} - INTERVAL 10 MINUTE""")
def str04_groups(spark, sf_dir):
    s = _events(spark, sf_dir).select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "at")
    out = streams.run_to_table(streams.stream_groups(s, "at", "1 hour", "10 minutes"), _folder(spark))
    return out.select("id", v.stamp("first").alias("first"), "n")


@query(f"""WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS b, event_type AS source FROM events, (VALUES (0), (1)) t(k)) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, source, count(*) AS n, count(*) > 2 * 4.0 AS flagged FROM w GROUP BY b, source HAVING b + INTERVAL 2 HOUR <= {LAST} - INTERVAL 10 MINUTE""")
def str05_rates(spark, sf_dir):
    s = _events(spark, sf_dir).withColumnRenamed("event_type", "source")
    base = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct().withColumn("expected", F.lit(4.0))
    out = streams.run_to_table(streams.stream_rates(s, base, "at", "2 hours", "1 hour", "10 minutes"), _folder(spark))
    return out.select(v.stamp("bucket").alias("bucket"), "source", "n", "flagged")


@query("SELECT a.event_id AS alert_id, b.event_id AS log_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000")
def str06_correlate(spark, sf_dir):
    a = _events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("entity"), "at")
    b = _events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("entity"), F.col("at").alias("seen"))
    return streams.run_to_table(streams.stream_correlate(a, b, "30 MINUTES", "1 hour"), _folder(spark)).select("alert_id", "log_id")


@query("SELECT event_id, n_name AS place FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey")
def str07_enrich(spark, sf_dir):
    s = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 40).cast("int").alias("n_nationkey"))
    return streams.run_to_table(streams.stream_enrich(s, v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey"), _folder(spark)).select("event_id", F.col("n_name").alias("place"))


@query("""WITH m AS (SELECT user_id AS usr, event_type || (event_id % 9) AS q, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, q) AS rank FROM m) SELECT usr AS "user", string_agg(q, ',' ORDER BY rank) AS queries FROM r WHERE rank <= 20 GROUP BY usr""")
def str08_recent(spark, sf_dir):
    q = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.col("event_id") % 9, F.lit(" ")))
    s = _events(spark, sf_dir).select(F.col("user_id").alias("user"), q.alias("q"), F.col("at").alias("ts"))
    return streams.run_to_table(streams.stream_recent(s, 20), _folder(spark), "update").select("user", F.array_join("queries", ",").alias("queries"))


@query(f"WITH e AS (SELECT ts, event_id % 10 = 0 AS again FROM events), m AS (SELECT max(ts) AS top FROM e WHERE NOT again) SELECT count(*) FILTER (WHERE NOT (again AND ts < top - INTERVAL 600 SECOND)) AS on_time, count(*) FILTER (WHERE again AND ts < top - INTERVAL 600 SECOND) AS late FROM e, m")
def str09_late(spark, sf_dir):
    """The events in two batches: a tenth of them comes after all others."""
    folder, events = _folder(spark), v.table(spark, sf_dir, "events")
    events = events.withColumn("at", F.col("ts").cast("timestamp"))
    for batch in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        events.where(batch).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        streams.stream_late(s, "at", 600, f"{folder}/good", f"{folder}/late", f"{folder}/state", f"{folder}/checkpoint")
    n = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("on_time" if name == "good" else name))
    return n("good").join(F.broadcast(n("late")))  # one row each


@query(f"SELECT strftime(b, '%Y-%m-%d') AS bucket, model, round(r, 6) AS reward, n FROM (SELECT date_trunc('day', ts) AS b, 'm' || (user_id % 3) AS model, avg(value) AS r, count(*) AS n FROM events GROUP BY 1, 2) WHERE b + INTERVAL 1 DAY <= {LAST} - INTERVAL 10 MINUTE")
def str10_rewards(spark, sf_dir):
    s = _events(spark, sf_dir).select("at", F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("value").alias("reward"))
    out = streams.run_to_table(streams.stream_rewards(s, "at", "1 day", "10 minutes"), _folder(spark))
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "model", F.round("reward", 6).alias("reward"), "n")


@query("SELECT event_type <> 'purchase' AS valid, count(*) AS n FROM events GROUP BY 1")
def str01_validate(spark, sf_dir):
    """Envelopes of the logs as a stream of JSON payloads; purchases bear an unknown severity."""
    from .. import schemas
    from ..sources import topics

    folder = _folder(spark)
    bad = v.logs(spark, sf_dir).withColumn("severity", F.when(F.col("source") == "purchase", "odd").otherwise(F.col("severity")))
    topics.encode_cloudevents(bad, "normalized.logs.v1", "test", "log_id", "observed_at").write.parquet(f"{folder}/in")
    s = spark.readStream.schema(schemas.ENVELOPE).parquet(f"{folder}/in")
    streams.stream_validate(s, "normalized.logs.v1", f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint")
    n = lambda name, ok: spark.read.parquet(f"{folder}/{name}").agg(F.lit(ok).alias("valid"), F.count("*").alias("n"))
    return n("good", True).unionByName(n("bad", False))


LOGS = f"SELECT log_id, source, severity, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS at FROM ({v.LOGS})"


def _shown(df):
    return df.select("log_id", "source", "severity", v.stamp("observed_at").alias("at"))


@query(LOGS)
def src01_read_artifacts(spark, sf_dir):
    """The logs as JSON lines in the shared folder, read back with the topic's schema."""
    from ..sources import topics

    folder = _folder(spark)
    v.logs(spark, sf_dir).write.json(f"{folder}/logs")
    return _shown(topics.read_artifacts(spark, f"{folder}/logs", "normalized.logs.v1", lines=True))


@query(f"SELECT log_id, source FROM ({v.LOGS})")
def src02_read_raw(spark, sf_dir):
    from ..sources import topics

    folder = _folder(spark)
    v.logs(spark, sf_dir).write.json(f"{folder}/logs")
    raw = topics.read_raw(spark, f"{folder}/logs", array=False)
    return raw.select(F.get_json_object("raw", "$.log_id").alias("log_id"), F.get_json_object("raw", "$.source").alias("source"))


@query(f"SELECT topic, source, count(*) AS n FROM (SELECT 'normalized.logs.v1' AS topic, event_type AS source FROM events UNION ALL SELECT 'dead-letter', 'events' FROM events WHERE event_type = 'error') GROUP BY 1, 2")
def src05_write_topics(spark, sf_dir):
    from ..sources import topics

    folder = _folder(spark)
    good = topics.encode_cloudevents(v.logs(spark, sf_dir), "normalized.logs.v1", "test", "log_id", "observed_at")
    topics.write_topics(good.unionByName(topics.encode_cloudevents(v.alerts(spark, sf_dir), "other", "test", "alert_id", "observed_at")), f"{folder}/topics", f"{folder}/dead")
    both = spark.read.parquet(f"{folder}/topics").unionByName(spark.read.parquet(f"{folder}/dead").withColumn("topic", F.lit("dead-letter")))
    return both.groupBy("topic", F.get_json_object("data", "$.source").alias("source")).agg(F.count("*").alias("n"))


@query(LOGS)
def src06_write_artifacts(spark, sf_dir):
    from ..sources import topics

    folder = _folder(spark)
    topics.write_artifacts(v.logs(spark, sf_dir), "normalized.logs.v1", folder)
    return _shown(spark.read.parquet(folder).where("topic = 'normalized.logs.v1' AND event_date >= '2023-01-01'"))


@query(LOGS)
def src07_08_stream_topic(spark, sf_dir):
    from .. import schemas
    from ..sources import topics

    folder = _folder(spark)
    v.logs(spark, sf_dir).write.parquet(f"{folder}/in")
    topics.write_stream_topic(topics.read_stream_topic(spark, f"{folder}/in", "normalized.logs.v1", "parquet"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _shown(spark.read.schema(schemas.TOPICS["normalized.logs.v1"]).parquet(f"{folder}/out"))


@query("""WITH e AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, 'log-' || event_id AS key, CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id % 2, ts, 'log-' || event_id) - 1 AS BIGINT) AS "offset" FROM events)
  SELECT *, (topic = 'click' AND partition = 1 AND "offset" BETWEEN 5 AND 59) OR (topic = 'view' AND partition = 2 AND "offset" >= 40) AS replayed FROM e""")
def src07_11_topic_log(spark, sf_dir):
    """The events as a log in two appends, streamed after each from where the checkpoint stands; and which rows a replay by offsets gives again."""
    from ..sources import log

    folder = _folder(spark)
    e = v.table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("log-"), F.col("event_id")).alias("key"), F.col("props").alias("value"))
    for half in (0, 1):
        log.append_log(rows.where(F.col("event_id") % 2 == half), f"{folder}/log")
        streams.start(log.read_log_stream(spark, f"{folder}/log"), f"{folder}/out", f"{folder}/checkpoint")
    again = log.replay_log(spark, f"{folder}/log", [("click", 1, 5, 40), ("click", 1, 30, 60), ("view", 2, 40, 1 << 40)]).select("topic", "partition", "offset", F.lit(True).alias("replayed"))
    return spark.read.schema(log.SCHEMA).parquet(f"{folder}/out").join(again, ["topic", "partition", "offset"], "left").select("topic", "partition", "offset", "key", F.coalesce("replayed", F.lit(False)).alias("replayed"))


@query("SELECT DISTINCT p_brand AS id, 'quality' AS kind, 0.0 AS lo, 2 AS n_dimensions FROM part")
def src13_read_metric_registry(spark, sf_dir):
    """A registry with one metric a brand, as a text file."""
    from ..sources import topics

    folder = _folder(spark)
    entry = F.concat(F.lit("  - id: '"), F.col("p_brand"), F.lit("'\n    kind: quality\n    range: [0, null]\n    dimensions: [split, topic]"))
    v.table(spark, sf_dir, "part").select("p_brand").distinct().select(entry.alias("value")).write.text(folder)
    return topics.read_metric_registry(spark, folder).select("id", "kind", F.col("range")[0].alias("lo"), F.size("dimensions").alias("n_dimensions"))


@query("SELECT p_name AS path, p_brand AS kind, CAST(p_size AS BIGINT) AS bytes, p_type AS path_repr FROM part")
def src14_read_inventory_tsv(spark, sf_dir):
    from ..sources import topics

    folder = _folder(spark)
    p = v.table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("bytes"), F.col("p_type").alias("path_repr"))
    p.write.option("sep", "\t").option("header", True).csv(folder)
    return topics.read_inventory_tsv(spark, folder)

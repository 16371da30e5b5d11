"""Topics: readers, writers, envelopes, routing, retention and replay (SRC-01 to SRC-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_artifacts(spark: SparkSession, path: str, topic: str, lines: bool = False) -> DataFrame:
    """SRC-01. Records of a topic from JSON arrays, or from JSON lines (which split), with the topic's fixed schema; an empty file has no rows."""
    return spark.read.schema(schemas.TOPICS[topic]).option("multiLine", not lines).json(path)


def read_raw(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """SRC-02. (raw): one JSON string a record, so that unknown keys and wrong types stay visible."""
    if not array:
        return spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("raw"))


def encode_cloudevents(df: DataFrame, topic: str, source: str, id_col: str, time_col: str) -> DataFrame:
    """SRC-03. Each row as a CloudEvents 1.0 envelope; data is the row as JSON."""
    names = [f.split(" ")[0] for f in schemas.ENVELOPE.split(", ")]
    have = {
        "specversion": F.lit("1.0"), "id": F.col(id_col).cast("string"), "source": F.lit(source), "type": F.lit(schemas.TYPE_PREFIX + topic), "time": F.col(time_col).cast("timestamp"),
        "datacontenttype": F.lit("application/json"), "data": F.to_json(F.struct(*df.columns)),
    }
    return df.select(*[have.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def decode_cloudevents(df: DataFrame, topic: str) -> DataFrame:
    """SRC-04. Rows of one event type: the parsed payload's columns, and the envelope's with the prefix ce_."""
    own = df.where(F.col("type") == schemas.TYPE_PREFIX + topic).withColumn("_d", F.from_json("data", schemas.TOPICS[topic]))
    return own.select("_d.*", *[F.col(c).alias(f"ce_{c}") for c in df.columns if c != "data"])


def route_topics(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """SRC-05. Envelopes with topic: the type without its prefix, or dead-letter if the catalog (by default the built-in one) lacks it. Write it with partitionBy("topic")."""
    names = list(schemas.TOPICS) if catalog is None else [r["name"] for r in catalog.select("name").collect()]  # topics are few
    name = F.regexp_replace("type", rf"^{schemas.TYPE_PREFIX.replace('.', '[.]')}", "")
    known = F.col("type").startswith(schemas.TYPE_PREFIX) & name.isin(*names)
    return df.withColumn("topic", F.when(known, name).otherwise(F.lit("dead-letter")))


def write_topics(df: DataFrame, path: str, dead_letter: str, mode: str = "append") -> None:
    """SRC-05. Envelopes written to Parquet by topic under path, and those of unknown types to dead_letter."""
    routed = route_topics(df)
    routed.where("topic <> 'dead-letter'").write.mode(mode).partitionBy("topic").parquet(path)
    routed.where("topic = 'dead-letter'").drop("topic").write.mode(mode).parquet(dead_letter)


def write_artifacts(df: DataFrame, topic: str, path: str, mode: str = "append") -> None:
    """SRC-06. Parquet by topic and event date."""
    df.withColumns({"topic": F.lit(topic), "event_date": F.to_date(schemas.KEYS[topic][1])}).write.mode(mode).partitionBy("topic", "event_date").parquet(path)


def read_stream_topic(spark: SparkSession, path: str, topic: str, form: str = "json") -> DataFrame:
    """SRC-07. Unbounded read of a topic's files; form is json or parquet."""
    return spark.readStream.schema(schemas.TOPICS[topic]).format(form).load(path)


def write_stream_topic(df: DataFrame, path: str, checkpoint: str):
    """SRC-08. All that is there now, exactly once, to Parquet files; returns the running query."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def apply_retention(df: DataFrame, topic: str, as_of: str, catalog: DataFrame | None = None) -> DataFrame:
    """SRC-09. Rows whose event time is at most the topic's retention before as_of: the built-in one, or the catalog's; a topic that the catalog keeps no time for keeps all."""
    if catalog is None:
        days = schemas.RETENTION_DAYS[topic]
    else:
        own = catalog.where(F.col("name") == topic).select("retention_days").first()
        days = own["retention_days"] if own else None
    return df if days is None else df.where(F.col(schemas.KEYS[topic][1]) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def replay_window(df: DataFrame, time_col: str, start: str, end: str) -> DataFrame:
    """SRC-10. Rows of an event-time window: start inclusive, end exclusive. Order is a sink's business: sort by time and key there."""
    return df.where((F.col(time_col) >= F.lit(start).cast("timestamp")) & (F.col(time_col) < F.lit(end).cast("timestamp")))


def replay_offsets(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """SRC-11. Rows whose (topic, partition) offset lies in a range [first, last) of ranges(topic, partition, first, last).

    Equi join on topic and partition. Ranges may overlap; a row comes once.
    """
    met = df.alias("d").join(ranges.alias("r"), F.expr("d.topic = r.topic AND d.partition = r.partition AND d.offset >= r.first AND d.offset < r.last"), "left_semi")
    return met


def inject(df: DataFrame, fixtures: DataFrame, run_id: str) -> DataFrame:
    """SRC-12. Stored rows and a fixture's rows, the latter with run_id; columns that one side lacks are null."""
    return df.withColumn("run_id", F.lit(None).cast("string")).unionByName(fixtures.withColumn("run_id", F.lit(run_id)), allowMissingColumns=True)


METRIC = "id string, kind string, range array<double>, unit string, dimensions array<string>, description string, shape string"


def _entries(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(e): the entries of a YAML-like list, each the text from its first key on; and readers of their scalars and [..] lists."""
    one = spark.read.text(path, wholetext=True)
    df = one.select(F.explode(F.split("value", r"(?m)^\s*-\s+(?=\w+:)")).alias("e"))
    unquote = lambda c: F.regexp_replace(c, r"""^["']|["']$""", "")
    get = lambda k: unquote(F.nullif(F.trim(F.regexp_extract("e", rf"(?m)^[ \t]*{k}:[ \t]*([^\n]*?)[ \t]*(?:[ \t]#[^\n]*)?$", 1)), F.lit("")))
    items = lambda k: F.transform(F.filter(F.split(F.regexp_replace(get(k), r"[\[\]]", ""), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    return df, {"get": get, "items": items}


def read_metric_registry(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13. Registry rows of a YAML-like list: an entry is a list item with a line `id: name`, be it the first or a later one; values are scalars or [..] lists."""
    df, to = _entries(spark, path)
    get, items = to["get"], to["items"]
    rows = df.select(get("id").alias("id"), get("kind").alias("kind"), F.transform(items("range"), lambda x: x.try_cast("double")).alias("range"), get("unit").alias("unit"), items("dimensions").alias("dimensions"), get("description").alias("description"), get("shape").alias("shape"))
    return rows.where("id IS NOT NULL")


def read_topic_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, retention_days, schema) of a topic catalog file; retention is in days, as 7d."""
    df, to = _entries(spark, path)
    get = to["get"]
    return df.select(get("name").alias("name"), get("kind").alias("kind"), F.regexp_extract(get("retention"), r"^(\d+)d$", 1).try_cast("int").alias("retention_days"), get("schema").alias("schema")).where("name IS NOT NULL")


def read_inventory_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14. (path, kind, bytes, path_repr) of a tab-separated file with a header."""
    return spark.read.schema("path string, kind string, bytes long, path_repr string").option("sep", "\t").option("header", True).csv(path)

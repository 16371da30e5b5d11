"""Record tables derived from the benchmark tables, and the same as SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize

SEVERITY = {"click": "debug", "view": "info", "signup": "notice", "purchase": "warning", "error": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def severity_of(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), c)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    who, what = F.concat(F.lit("u"), F.col("user_id")), F.concat(F.lit("svc-"), F.col("event_type"))
    return normalize.normalize_logs(e, {
        "log_id": F.concat(F.lit("log-"), F.col("event_id")), "observed_at": F.col("ts").cast("timestamp"), "source": F.col("event_type"), "message": F.concat(F.col("event_type"), F.lit(" by "), who, F.lit(" value "), F.format_string("%.2f", "value")),
        "severity": severity_of(F.col("event_type")), "fields": F.col("props"), "entities": F.array(normalize.entity("user", who), normalize.entity("service", what)),
    })


LOGS = """SELECT 'log-' || event_id AS log_id, ts AS observed_at, event_type AS source, 'u' || user_id AS usr, 'svc-' || event_type AS svc, user_id, value, props,
  CASE event_type WHEN 'click' THEN 'debug' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'notice' WHEN 'purchase' THEN 'warning' WHEN 'error' THEN 'error' END AS severity,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS rank FROM events"""
MENTIONS = f"SELECT log_id AS record_id, 'user' AS kind, usr AS id, severity, rank, source, observed_at FROM ({LOGS}) UNION ALL SELECT log_id, 'service', svc, severity, rank, source, observed_at FROM ({LOGS})"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    who = F.concat(F.lit("u"), F.col("user_id"))
    tags = F.array(F.lit("error"), F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 10), F.when(F.col("value") > 10, "large").otherwise("small"))
    return normalize.normalize_alerts(e, {
        "alert_id": F.concat(F.lit("alert-"), F.col("event_id")), "observed_at": F.col("ts").cast("timestamp"), "severity": F.when(F.col("value") > 50, "critical").otherwise("error"), "title": F.concat(F.lit("error of "), who),
        "source": F.lit("events"), "raw_ref": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("doc-"), F.col("event_id"))), "tags": tags, "entities": F.array(normalize.entity("user", who)), "attributes": F.col("props"),
    })


ALERTS = "SELECT 'alert-' || event_id AS alert_id, event_id, ts AS observed_at, CASE WHEN value > 50 THEN 'critical' ELSE 'error' END AS severity, 'u' || user_id AS usr, value, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, CASE WHEN event_id % 3 = 0 THEN 'doc-' || event_id END AS raw_ref FROM events WHERE event_type = 'error'"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, severity, source, observed_at, kind, id) of the logs."""
    return normalize.explode_entities(logs(spark, sf_dir), "log_id", "severity", "source", "observed_at").drop("name", "labels")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of orders: scenario from the priority, status from the order's, provenance as raw JSON."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    part = lambda n, k, v: F.when(F.col("o_orderkey") % n != 0, F.concat(F.lit(f'"{k}":'), v))
    prov = F.concat(F.lit("{"), F.concat_ws(",", part(5, "git", F.lit('"abc"')), part(7, "images", F.when(F.col("o_orderkey") % 2 == 0, "{}").otherwise("null")), part(11, "schemas", F.lit('"v1"')), F.concat(F.lit('"offsets":'), F.when(F.col("o_orderkey") % 13 == 0, "false").otherwise("1"))), F.lit("}"))
    return o.select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.col("o_orderpriority").alias("scenario"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, o_orderkey % 90, 0)")).cast("timestamp").alias("finished_at"), prov.alias("provenance"), "o_orderkey", "o_custkey", "o_totalprice")


RUNS = """SELECT 'run-' || o_orderkey AS run_id, o_orderpriority AS scenario, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at, o_orderkey, o_custkey, o_totalprice FROM orders"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) topology: region - nation - supplier."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    return a.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst")))


EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"

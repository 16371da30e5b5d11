"""Queries of sources, validation, normalisation and run evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, normalize, validate
from ..sources import topics
from . import views as v

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@query(f"""WITH l AS ({v.LOGS}), c AS (SELECT 'run-' || source AS run_id, 'normalized.logs.v1' AS artifact, count(*) AS n FROM l WHERE observed_at >= TIMESTAMP '{START}' AND observed_at < TIMESTAMP '{END}' GROUP BY source),
  a AS (SELECT 'run-' || s AS run_id, m AS min FROM (VALUES ('click', 1), ('view', 100000), ('nothing', 1)) t(s, m))
  SELECT a.run_id, CASE WHEN coalesce(n, 0) >= min THEN 'completed' ELSE 'failed' END AS status, 'counts_min normalized.logs.v1 ' || CASE WHEN coalesce(n, 0) >= min THEN 'passed' ELSE 'failed' END || ' ' || coalesce(n, 0) || ' of ' || min AS shown,
  CAST(CASE WHEN coalesce(n, 0) >= min THEN 1 ELSE 0 END AS BIGINT) AS n_passed FROM a LEFT JOIN c USING (run_id)""")
def qes04_evaluate_runspec(spark, sf_dir):
    """The minimum slice: logs, a replay window, valid rows, counts, assertions, run records."""
    valid, _ = validate.validate(topics.replay_window(v.logs(spark, sf_dir), "observed_at", START, END), "normalized.logs.v1")
    counts = valid.groupBy(F.concat(F.lit("run-"), F.col("source")).alias("run_id"), F.lit("normalized.logs.v1").alias("artifact")).agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([("run-click", "normalized.logs.v1", 1), ("run-view", "normalized.logs.v1", 100000), ("run-nothing", "normalized.logs.v1", 1)], "run_id string, artifact string, min int")
    out = evaluate.evaluate_runspec(evaluate.assert_counts_min(counts, wanted))
    return out.select("run_id", "status", F.array_join(F.transform("assertions", lambda a: F.concat_ws(" ", a["type"], a["artifact"], a["outcome"], a["detail"])), ";").alias("shown"), "n_passed")


@query(f"SELECT log_id AS id, 'qes.normalized.logs.v1' AS type, 'normalized.logs.v1' AS topic, {TS.format('observed_at')} AS at, '1.0' AS specversion FROM ({v.LOGS}) UNION ALL SELECT alert_id, 'qes.other', 'dead-letter', {TS.format('observed_at')}, '1.0' FROM ({v.ALERTS})")
def src03_05_envelopes(spark, sf_dir):
    a = topics.encode_cloudevents(v.logs(spark, sf_dir), "normalized.logs.v1", "test", "log_id", "observed_at")
    b = topics.encode_cloudevents(v.alerts(spark, sf_dir), "other", "test", "alert_id", "observed_at")
    return topics.route_topics(a.unionByName(b)).select("id", "type", "topic", v.stamp("time").alias("at"), "specversion")


@query(f"SELECT log_id, source, severity, {TS.format('observed_at')} AS at, log_id AS envelope, usr AS who FROM ({v.LOGS})")
def src04_decode_cloudevents(spark, sf_dir):
    a = topics.encode_cloudevents(v.logs(spark, sf_dir), "normalized.logs.v1", "test", "log_id", "observed_at")
    return topics.decode_cloudevents(a, "normalized.logs.v1").select("log_id", "source", "severity", v.stamp("observed_at").alias("at"), F.col("ce_id").alias("envelope"), F.col("entities")[0]["id"].alias("who"))


@query(f"SELECT source, count(*) AS n FROM ({v.LOGS}) WHERE observed_at >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY GROUP BY source")
def src09_retention(spark, sf_dir):
    return topics.apply_retention(v.logs(spark, sf_dir), "normalized.logs.v1", "2024-01-25 00:00:00").groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT log_id, {TS.format('observed_at')} AS at FROM ({v.LOGS}) WHERE observed_at >= TIMESTAMP '{START}' AND observed_at < TIMESTAMP '{END}'")
def src10_replay_window(spark, sf_dir):
    return topics.replay_window(v.logs(spark, sf_dir), "observed_at", START, END).select("log_id", v.stamp("observed_at").alias("at"))


def _offsets(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(F.concat(F.lit("run-"), F.col("user_id") % 7).alias("run_id"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.concat(F.lit("v"), F.col("event_id") % 2).alias("schema_version"))


@query("SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS offset FROM events WHERE (event_type = 'click' AND user_id % 4 = 1 AND event_id < 3000) OR (event_type = 'view' AND user_id % 4 = 2 AND event_id >= 100 AND event_id < 5000)")
def src11_replay_offsets(spark, sf_dir):
    ranges = spark.createDataFrame([("click", 1, 0, 3000), ("view", 2, 100, 4000), ("view", 2, 3000, 5000)], "topic string, partition int, first long, last long")
    return topics.replay_offsets(_offsets(spark, sf_dir), ranges).select("topic", "partition", "offset")


@query(f"SELECT log_id, source, CAST(NULL AS VARCHAR) AS run_id FROM ({v.LOGS}) UNION ALL SELECT alert_id, 'events', 'r1' FROM ({v.ALERTS})")
def src12_inject(spark, sf_dir):
    extra = v.alerts(spark, sf_dir).select(F.col("alert_id").alias("log_id"), "source", "title")
    return topics.inject(v.logs(spark, sf_dir), extra, "r1").select("log_id", "source", "run_id")


RAW = "CASE event_id % 9 WHEN 0 THEN '{\"id\":\"x\",\"n\":1,\"at\":\"2024-01-01T00:00:00Z\",\"labels\":{\"a\":\"b\"}}' WHEN 1 THEN '{\"id\":\"\",\"n\":\"1\",\"at\":\"2024-01-01\",\"labels\":{\"a\":1,\"c\":\"d\"}}' WHEN 2 THEN '{\"n\":2.5,\"zz\":1}' WHEN 3 THEN '{\"id\":7,\"at\":\"no\"}' ELSE '{\"id\":\"y\"}' END"


@query("""WITH k AS (SELECT event_id % 9 AS m, CAST(event_id AS VARCHAR) AS record_id FROM events),
  r AS (SELECT * FROM (VALUES (1, 'n', 'type', 'STRING'), (3, 'id', 'type', 'BIGINT'), (2, '$', 'additionalProperties', 'zz'), (1, 'at', 'date-time', '2024-01-01'), (3, 'at', 'date-time', 'no'), (1, 'labels', 'valueType', 'a')) t(m, path, rule, actual))
  SELECT 'raw' AS topic, record_id, path, rule, actual FROM k JOIN r USING (m)""")
def val02_07_08_11_raw_rules(spark, sf_dir):
    raw = v.table(spark, sf_dir, "events").select("event_id", F.expr(RAW).alias("raw"))
    r = F.col("raw")
    rules = validate.rule_type(r, {"id": "string", "n": "number"}) + validate.rule_closed(r, ["id", "n", "at", "labels"]) + validate.rule_datetime(r, ["at"]) + validate.rule_typed_map(r, ["labels"])
    return validate.violations(raw, "raw", "event_id", rules)


@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS record_id, event_id, event_type, value FROM events)
  SELECT 'typed' AS topic, record_id, 'kind' AS path, 'required' AS rule, CAST(NULL AS VARCHAR) AS actual FROM e WHERE event_type = 'view'
  UNION ALL SELECT 'typed', record_id, 'kind', 'minLength', event_type FROM e WHERE event_type <> 'view' AND length(event_type) < 6
  UNION ALL SELECT 'typed', record_id, 'kind', 'enum', event_type FROM e WHERE event_type NOT IN ('view', 'click', 'error')
  UNION ALL SELECT 'typed', record_id, 'small', 'range', CAST(event_id % 10 AS VARCHAR) FROM e WHERE event_id % 10 > 7
  UNION ALL SELECT 'typed', record_id, 'items', 'minItems', CAST(event_id % 3 AS VARCHAR) FROM e WHERE event_id % 3 < 1
  UNION ALL SELECT 'typed', record_id, 'name', 'pattern', 'prog:' || (event_id % 20) FROM e WHERE event_id % 20 >= 10
  UNION ALL SELECT 'typed', record_id, 'version', 'const', '0.3' FROM e WHERE event_id % 50 = 0
  UNION ALL SELECT 'typed', record_id, 'items[]', 'notempty', '1' FROM e WHERE event_id % 3 = 2""")
def val01_12_typed_rules(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    items = F.expr("CASE event_id % 3 WHEN 0 THEN array() WHEN 1 THEN array('a') ELSE array('a', '') END")
    df = e.select("event_id", F.expr("nullif(event_type, 'view')").alias("kind"), (F.col("event_id") % 10).alias("small"), items.alias("items"), F.concat(F.lit("prog:"), F.col("event_id") % 20).alias("name"), F.when(F.col("event_id") % 50 == 0, "0.3").otherwise("1.0").alias("version"))
    rules = validate.rule_required("kind") + validate.rule_min_length({"kind": 6}) + validate.rule_enum({"kind": ["click", "error"]}) + validate.rule_range({"small": (0, 7)}) + validate.rule_min_items({"items": 1})
    rules += validate.rule_pattern({"name": "^prog:[0-9]$"}) + validate.rule_const({"version": "1.0"}) + validate.rule_elements("items", "notempty", lambda x: F.length(x) == 0)
    return validate.violations(df, "typed", "event_id", rules)


@query("SELECT 'x' AS topic, 'enum' AS rule, 'severity' AS path, count(*) AS n FROM events WHERE event_type = 'purchase' HAVING count(*) > 0")
def val13_14_quarantine(spark, sf_dir):
    bad = v.logs(spark, sf_dir).withColumn("severity", F.when(F.col("source") == "purchase", "odd").otherwise(F.col("severity")))
    _, held = validate.validate(bad, "normalized.logs.v1")
    return validate.violation_summary(held.select(F.lit("x").alias("topic"), F.explode("violations").alias("x")).select("topic", "x.rule", "x.path"))


@query("""SELECT 'p' || p_partkey AS name, CASE WHEN p_size % 5 = 0 THEN 'no schema' WHEN p_size % 5 = 1 THEN 'schema missing' ELSE 'not JSON' END AS problem FROM part WHERE p_size % 5 IN (0, 1) OR (p_size % 5 = 2)""")
def val15_catalog_coverage(spark, sf_dir):
    catalog = v.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("s"), F.col("p_size") % 5)).alias("schema"))
    registry = spark.createDataFrame([("s2", "{nope"), ("s3", "{}"), ("s4", '{"a": 1}')], "schema string, body string")
    return validate.catalog_coverage(catalog, registry)


@query("""WITH d AS (SELECT event_type AS producer, CAST(ts AS DATE) AS day, CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0.0 END AS bad FROM events), b AS (SELECT producer, day, avg(bad) AS share, count(*) AS n FROM d GROUP BY producer, day)
  SELECT producer, strftime(day, '%Y-%m-%d') AS day, round(share, 6) AS share, n, round(share - lag(share) OVER (PARTITION BY producer ORDER BY day), 6) AS change FROM b""")
def val16_compat_drift(spark, sf_dir):
    raw = F.when(F.col("user_id") % 10 == 0, F.lit('{"k":1,"zz":2}')).when(F.col("user_id") % 5 == 0, F.lit("{}")).otherwise(F.lit('{"k":1}'))
    df = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("producer"), F.to_date("ts").alias("day"), raw.alias("raw"))
    out = validate.compat_drift(df, ["k"], ["k"])
    return out.select("producer", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("share", 6).alias("share"), "n", F.round("change", 6).alias("change"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_type END, 'merge') AS mode, coalesce(CASE WHEN p_size > 25 THEN p_size END, 1) AS page FROM part")
def val17_apply_defaults(spark, sf_dir):
    df = v.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_type")).alias("mode"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("page"))
    return validate.apply_defaults(df)


@query(f"SELECT alert_id, {TS.format('observed_at')} AS at, severity, 'error of ' || usr AS title, raw_ref FROM ({v.ALERTS})")
def nrm02_alerts(spark, sf_dir):
    return v.alerts(spark, sf_dir).select("alert_id", v.stamp("observed_at").alias("at"), "severity", "title", "raw_ref")


@query(f"SELECT log_id, source, severity, CAST(rank AS INTEGER) AS rank, {TS.format('observed_at')} AS at FROM ({v.LOGS})")
def nrm01_03_logs(spark, sf_dir):
    return v.logs(spark, sf_dir).select("log_id", "source", "severity", normalize.severity_rank(F.col("severity")).cast("int").alias("rank"), v.stamp("observed_at").alias("at"))


@query(f"SELECT source, severity, strftime(date_trunc('hour', observed_at), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM ({v.LOGS}) GROUP BY ALL")
def nrm04_severity_rollup(spark, sf_dir):
    return normalize.severity_rollup(v.logs(spark, sf_dir), "observed_at", "1 hour").withColumn("bucket", v.stamp("bucket"))


@query(f"SELECT record_id, kind, id FROM ({v.MENTIONS})")
def nrm05_explode_entities(spark, sf_dir):
    return v.mentions(spark, sf_dir).select("record_id", "kind", "id")


@query(f"SELECT kind, id, count(DISTINCT record_id) AS n_records, {TS.format('min(observed_at)')} AS first_seen, {TS.format('max(observed_at)')} AS last_seen, arg_max(severity, rank) AS worst, count(DISTINCT source) AS n_sources FROM ({v.MENTIONS}) GROUP BY kind, id")
def nrm06_entity_profile(spark, sf_dir):
    return normalize.entity_profile(v.mentions(spark, sf_dir), "observed_at").withColumns({"first_seen": v.stamp("first_seen"), "last_seen": v.stamp("last_seen")})


@query(f"""WITH t AS (SELECT kind, id, 'logs' AS topic, record_id, observed_at FROM ({v.MENTIONS}) UNION ALL SELECT 'user', usr, 'alerts', alert_id, observed_at FROM ({v.ALERTS}))
  SELECT kind, id, topic, record_id, CAST(row_number() OVER (PARTITION BY kind, id ORDER BY observed_at, topic, record_id) AS INTEGER) AS seq FROM t""")
def nrm07_entity_timeline(spark, sf_dir):
    a = v.mentions(spark, sf_dir).select("kind", "id", F.lit("logs").alias("topic"), "record_id", F.col("observed_at").alias("time"))
    b = normalize.explode_entities(v.alerts(spark, sf_dir), "alert_id", "observed_at").select("kind", "id", F.lit("alerts").alias("topic"), "record_id", F.col("observed_at").alias("time"))
    return normalize.entity_timeline(a, b).drop("time").withColumn("seq", F.col("seq").cast("int"))


@query("SELECT 'log-' || event_id AS log_id FROM events WHERE user_id % 3 = 0 AND event_type = 'click'")
def nrm08_filter_labels(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("tier"), (F.col("user_id") % 3).cast("string"), F.lit("type"), F.col("event_type"))
    df = e.select(F.concat(F.lit("log-"), F.col("event_id")).alias("log_id"), F.array(F.struct(labels.alias("labels"))).alias("entities"))
    return normalize.filter_labels(df, {"tier": "0", "type": "click"}).select("log_id")


@query(f"SELECT tag, count(*) AS n FROM (SELECT 'error' AS tag FROM ({v.ALERTS}) UNION ALL SELECT 'k' || k FROM ({v.ALERTS}) UNION ALL SELECT CASE WHEN value > 10 THEN 'large' ELSE 'small' END FROM ({v.ALERTS})) GROUP BY tag")
def nrm09_tag_counts(spark, sf_dir):
    return normalize.tag_counts(v.alerts(spark, sf_dir))


@query(f"SELECT kind, count(DISTINCT id) AS n, true AS known FROM ({v.MENTIONS}) GROUP BY kind")
def nrm10_kind_report(spark, sf_dir):
    return normalize.kind_report(v.mentions(spark, sf_dir))


@query(f"SELECT a.alert_id, d.text IS NOT NULL AS found, a.raw_ref IS NOT NULL AND d.text IS NULL AS unresolved FROM ({v.ALERTS}) a LEFT JOIN (SELECT 'doc-' || doc_id AS ref, text FROM documents) d ON a.raw_ref = d.ref")
def nrm11_resolve_raw_ref(spark, sf_dir):
    blobs = v.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("ref"), F.col("text").alias("blob"))
    return normalize.resolve_raw_ref(v.alerts(spark, sf_dir), blobs).select("alert_id", F.col("blob").isNotNull().alias("found"), "unresolved")


@query("SELECT 'o' || o_orderkey AS artifact_id, 'c' || r AS ref, r > (SELECT max(c_custkey) FROM customer) OR r NOT IN (SELECT c_custkey FROM customer) AS dangling FROM (SELECT o_orderkey, o_custkey AS r FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1000 FROM orders)")
def nrm12_resolve_refs(spark, sf_dir):
    art = v.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.array(F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("c"), F.col("o_custkey") + 1000)).alias("refs"))
    return normalize.resolve_refs(art, "id", "refs", v.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("record_id")))


@query("""WITH a AS (SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders) EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END FROM orders)
  SELECT CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS missing, count(*) AS extra FROM a""")
def qes02_match_golden(spark, sf_dir):
    golden = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    actual = golden.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.lit(0.0)})
    return evaluate.assert_match_golden(actual, golden, ["o_totalprice"])


@query("""WITH m AS (SELECT o_orderpriority AS run_id, avg(o_totalprice) AS value FROM orders GROUP BY 1), a AS (SELECT DISTINCT o_orderpriority AS run_id, 1000.0 AS gte FROM orders UNION ALL SELECT 'none', 1.0)
  SELECT a.run_id, 'metric_threshold' AS type, 'price' AS artifact, CASE WHEN value IS NULL THEN 'skipped' WHEN value >= gte THEN 'passed' ELSE 'failed' END AS outcome FROM a LEFT JOIN m USING (run_id)""")
def qes03_metric_threshold(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    metrics = o.groupBy(F.col("o_orderpriority").alias("run_id"), F.lit("price").alias("artifact")).agg(F.avg("o_totalprice").alias("value"))
    wanted = o.select(F.col("o_orderpriority").alias("run_id")).distinct().withColumn("gte", F.lit(1000.0)).unionByName(spark.createDataFrame([("none", 1.0)], "run_id string, gte double")).withColumn("artifact", F.lit("price"))
    return evaluate.assert_metric_threshold(metrics, wanted).drop("detail")


@query(f"SELECT run_id, status, status = 'completed' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS allowed FROM ({v.RUNS})")
def qes05_provenance_gate(spark, sf_dir):
    return evaluate.provenance_gate(v.runs(spark, sf_dir)).select("run_id", "status", "allowed")


@query("SELECT 'run-' || (user_id % 7) AS run_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, min(event_id) AS first_offset, max(event_id) AS last_offset, count(*) AS n, string_agg(DISTINCT 'v' || (event_id % 2), ',' ORDER BY 'v' || (event_id % 2)) AS schema_versions FROM events GROUP BY 1, 2, 3")
def qes06_capture_provenance(spark, sf_dir):
    return evaluate.capture_provenance(_offsets(spark, sf_dir)).withColumn("schema_versions", F.array_join("schema_versions", ","))


@query("""WITH e AS (SELECT 'run-' || (user_id % 7) AS run_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, min(event_id) AS first_offset, max(event_id) AS last_offset FROM events GROUP BY 1, 2, 3)
  SELECT e.*, CASE WHEN o_orderkey IS NOT NULL THEN 'group=' || o_orderstatus || ',ingest=v' || (o_orderkey % 3) END AS pipelines FROM e LEFT JOIN orders ON e.run_id = 'run-' || o_orderkey""")
def qes06_pipeline_provenance(spark, sf_dir):
    m = F.create_map(F.lit("ingest"), F.concat(F.lit("v"), F.col("o_orderkey") % 3), F.lit("group"), F.col("o_orderstatus"))
    runs = v.table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), m.alias("pipelines"))
    out = evaluate.capture_provenance(_offsets(spark, sf_dir), runs)
    names = F.array_sort(F.transform(F.map_entries("pipelines"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return out.select("run_id", "topic", "partition", "first_offset", "last_offset", F.when(F.col("pipelines").isNotNull(), F.array_join(names, ",")).alias("pipelines"))


@query("""WITH l AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0), r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'B' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 6 = 0 THEN -1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 9 <> 0)
  SELECT * FROM (SELECT coalesce(l.p_partkey, r.p_partkey) AS p_partkey, CASE WHEN l.p_partkey IS NULL THEN 'added' WHEN r.p_partkey IS NULL THEN 'removed' WHEN l.p_brand <> r.p_brand OR l.p_size <> r.p_size THEN 'changed' END AS change,
  CASE WHEN l.p_brand <> r.p_brand AND l.p_size <> r.p_size THEN 'p_brand,p_size' WHEN l.p_brand <> r.p_brand THEN 'p_brand' WHEN l.p_size <> r.p_size THEN 'p_size' END AS columns FROM l FULL OUTER JOIN r ON l.p_partkey = r.p_partkey) WHERE change IS NOT NULL""")
def qes07_diff_artifacts(spark, sf_dir):
    p = v.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    right = p.where("p_partkey % 9 <> 0").withColumns({"p_brand": F.when(F.col("p_partkey") % 4 == 0, "B").otherwise(F.col("p_brand")), "p_size": F.when(F.col("p_partkey") % 6 == 0, -1).otherwise(F.col("p_size"))})
    return evaluate.diff_artifacts(p.where("p_partkey % 10 <> 0"), right, "p_partkey")


@query(f"""SELECT scenario, run_id, status, CAST(row_number() OVER w AS INTEGER) AS seq, lead(run_id) OVER w IS NULL AS latest, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY scenario ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS pass_rate,
  coalesce((lag(status) OVER w = 'completed') <> (status = 'completed'), false) AS flip FROM ({v.RUNS}) WINDOW w AS (PARTITION BY scenario ORDER BY started_at, run_id)""")
def qes08_run_history(spark, sf_dir):
    return evaluate.run_history(v.runs(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


_PRINTS = "SELECT l_returnflag || '-' || (l_orderkey % 10) AS run_id, l_linestatus AS artifact, CAST(sum(CAST(CAST('0x' || substr(md5(CAST(l_linenumber AS VARCHAR) || chr(31) || CAST(l_partkey AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fp, count(*) AS n_rows FROM lineitem GROUP BY 1, 2"


@query(f"WITH p AS ({_PRINTS}) SELECT substr(run_id, 1, 1) AS spec_hash, 'o' AS offsets, artifact, count(DISTINCT fp) AS n_fp, count(DISTINCT run_id) AS n_runs FROM p GROUP BY 1, 2, 3 HAVING count(DISTINCT fp) > 1")
def qes09_determinism_check(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").withColumn("run_id", F.concat_ws("-", "l_returnflag", (F.col("l_orderkey") % 10).cast("string")))
    prints = evaluate.fingerprint(li, ["l_linenumber", "l_partkey"], ["run_id", F.col("l_linestatus").alias("artifact")])
    runs = li.select("run_id", F.substring("run_id", 1, 1).alias("spec_hash"), F.lit("o").alias("offsets")).distinct()
    return evaluate.determinism_check(runs, prints)


@query(_PRINTS)
def qes10_fingerprint(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").withColumn("run_id", F.concat_ws("-", "l_returnflag", (F.col("l_orderkey") % 10).cast("string")))
    return evaluate.fingerprint(li, ["l_linenumber", "l_partkey"], ["run_id", F.col("l_linestatus").alias("artifact")])


@query("SELECT 'run-' || o_orderkey AS run_id, sha256('dataset=d' || (o_custkey % 3) || chr(10) || CASE WHEN o_orderkey % 4 > 0 THEN 'mode=' || o_orderstatus || chr(10) ELSE '' END || 'scenario=' || o_orderpriority) AS spec_hash FROM orders")
def qes10_runspec_hash(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    spec = evaluate.runspec_hash(scenario=F.col("o_orderpriority"), mode=F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")), dataset=F.concat(F.lit("d"), F.col("o_custkey") % 3))
    return o.select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), spec.alias("spec_hash"))


@query("SELECT 'run-' || o_orderkey AS run_id, 'v' || (o_orderkey % 3) AS ingest, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS group_ FROM orders")
def qes11_pipeline_versions(spark, sf_dir):
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("ingest"), F.concat(F.lit("v"), F.col("o_orderkey") % 3), F.lit("group_"), F.col("o_orderstatus"))).otherwise(F.create_map(F.lit("ingest"), F.concat(F.lit("v"), F.col("o_orderkey") % 3)))
    return evaluate.pipeline_versions(v.table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), m.alias("pipelines")), ["ingest", "group_"])


@query(f"""SELECT status, count(*) AS n, round(avg(CASE WHEN status <> 'running' THEN (o_orderkey % 90) * 60 END), 6) AS mean_s, CAST(max(CASE WHEN status <> 'running' THEN (o_orderkey % 90) * 60 END) AS DOUBLE) AS max_s, count(*) FILTER (WHERE status = 'running' AND started_at < TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 3600 SECOND) AS n_late FROM ({v.RUNS}) GROUP BY status""")
def qes12_run_durations(spark, sf_dir):
    return evaluate.run_durations(v.runs(spark, sf_dir), "2001-01-01 00:00:00", 3600).withColumns({"mean_s": F.round("mean_s", 6), "max_s": F.col("max_s").cast("double")})


@query(f"SELECT run_id, status, CASE WHEN status <> 'running' THEN CAST((o_orderkey % 90) * 60 AS BIGINT) END AS seconds FROM ({v.RUNS})")
def qes12_run_duration(spark, sf_dir):
    return evaluate.run_duration(v.runs(spark, sf_dir))


@query(f"""WITH p AS (SELECT scenario, run_id, started_at, 'ingest' AS name, 'v' || (o_orderkey % 3) AS version FROM ({v.RUNS}) UNION ALL SELECT scenario, run_id, started_at, 'rank', status FROM ({v.RUNS}) WHERE o_orderkey % 2 = 0),
  b AS (SELECT *, lag(version) OVER (PARTITION BY scenario, name ORDER BY started_at, run_id) AS before FROM p) SELECT scenario, name, run_id, before, version FROM b WHERE before <> version""")
def qes11_version_changes(spark, sf_dir):
    ingest = F.concat(F.lit("v"), F.col("o_orderkey") % 3)
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("ingest"), ingest, F.lit("rank"), F.col("status"))).otherwise(F.create_map(F.lit("ingest"), ingest))
    return evaluate.version_changes(v.runs(spark, sf_dir).withColumn("pipelines", m))

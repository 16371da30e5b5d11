"""Queries of the incident pipelines and of contender evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contenders, incidents
from ..schemas import columns
from . import views as v

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


GAP = 3600
M = f"SELECT record_id, kind, id, observed_at AS tm, severity, rank, source FROM ({v.MENTIONS})"
G = f"SELECT *, kind || ':' || id || ':' || sum(new) OVER (PARTITION BY kind, id ORDER BY tm, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_id FROM (SELECT *, CASE WHEN epoch_us(tm) - lag(epoch_us(tm)) OVER (PARTITION BY kind, id ORDER BY tm, record_id) > {GAP * 1_000_000} THEN 1 ELSE 0 END AS new FROM ({M}))"
PAIRS = f"SELECT x.record_id AS a, y.record_id AS b, x.kind, x.id FROM ({M}) x JOIN ({M}) y ON x.kind = y.kind AND x.id = y.id AND epoch_us(y.tm) - epoch_us(x.tm) BETWEEN 0 AND {GAP * 1_000_000} AND (y.tm > x.tm OR x.record_id < y.record_id)"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _m(spark, sf_dir):
    return v.mentions(spark, sf_dir).withColumnRenamed("observed_at", "at")


def _groups(spark, sf_dir):
    g = incidents.group_by_gap(_m(spark, sf_dir), GAP)
    return g.withColumn("group_id", F.concat_ws(":", "kind", "id", F.col("group_no").cast("string")))


def _shown(entities):
    """kind:id of each entity, joined."""
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["kind"], e["id"])), ",")


def _valid(df, topic):
    """The rows that hold the topic's contract, all of its columns in order."""
    from ..operators.validate import validate

    return validate(df.select(*columns(topic)), topic)[0]


@query(PAIRS)
def grp01_correlate_pairs(spark, sf_dir):
    return incidents.correlate_pairs(_m(spark, sf_dir), GAP)


@query(f"SELECT record_id, group_id FROM ({G})")
def grp02_group_by_gap(spark, sf_dir):
    return _groups(spark, sf_dir).select("record_id", "group_id")


def _rounds(n: int) -> str:
    """Smallest label over groups and their records, and then the label of that label, n times: lengths of chains halve."""
    out = "l0 AS MATERIALIZED (SELECT record_id, min(record_id) AS c FROM e GROUP BY record_id)"
    for i in range(1, n + 1):
        out += f", m{i} AS MATERIALIZED (SELECT e.record_id, min(g.c) AS c FROM e JOIN (SELECT e.group_id, min(l{i - 1}.c) AS c FROM e JOIN l{i - 1} USING (record_id) GROUP BY e.group_id) g USING (group_id) GROUP BY e.record_id)"
        out += f", l{i} AS MATERIALIZED (SELECT m.record_id, least(m.c, j.c) AS c FROM m{i} m JOIN m{i} j ON j.record_id = m.c)"
    return out


@query(f"WITH e AS MATERIALIZED (SELECT record_id, group_id FROM (SELECT record_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM ({G})) WHERE n > 1), {_rounds(24)} SELECT record_id AS node, c AS component FROM l24")
def grp03_group_components(spark, sf_dir):
    return incidents.group_components(incidents.consecutive_pairs(_m(spark, sf_dir), GAP))


@query(f"""WITH g AS ({G}), p AS ({PAIRS}), n AS (SELECT group_id, count(*) AS np FROM p JOIN g ON p.a = g.record_id AND p.kind = g.kind AND p.id = g.id GROUP BY group_id)
  SELECT g.group_id, {STAMP.format("max(tm)")} AS created_at, string_agg(record_id, ',' ORDER BY record_id) AS members, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE coalesce(max(np), 0) / (count(*) * (count(*) - 1) / 2.0) END, 6) AS score, count(*) || ' records' AS reason, CAST(NULL AS VARCHAR) AS attributes FROM g LEFT JOIN n USING (group_id) GROUP BY g.group_id""")
def grp04_emit_event_groups(spark, sf_dir):
    g = _groups(spark, sf_dir)
    out = _valid(incidents.emit_event_groups(g, incidents.count_pairs(g, GAP)), "event.groups.v1")
    return out.select("group_id", v.stamp("created_at").alias("created_at"), F.array_join("member_refs", ",").alias("members"), F.round("score", 6).alias("score"), "reason", "attributes")


@query(f"SELECT node, string_agg(n, ',' ORDER BY n) AS neighbors FROM (SELECT src AS node, dst AS n FROM ({v.EDGES}) UNION SELECT dst, src FROM ({v.EDGES})) GROUP BY node")
def loc01_topology_neighbors(spark, sf_dir):
    return incidents.topology_neighbors(v.edges(spark, sf_dir)).withColumn("neighbors", F.array_join("neighbors", ","))


@query("SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey || '>n' || n_nationkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 'r' || n_regionkey || '>n' || n_nationkey || '>s' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def loc02_topology_path(spark, sf_dir):
    roots = v.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("start"))
    return incidents.topology_path(v.edges(spark, sf_dir), roots, 5).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH m AS (SELECT l_orderkey, 's' || l_suppkey AS id FROM lineitem), n AS (SELECT l_orderkey, id, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, id) AS r FROM n),
  e AS ({v.EDGES}) SELECT 'o' || l_orderkey AS ref_id, '2024-02-01 00:00:00' AS localized_at, 'service:' || b.id AS "primary", round(n / total, 6) AS confidence, 'service:' || e.src AS near, 'service:r' || n_regionkey || ',service:' || e.src || ',service:' || b.id AS path, '{{"mentions":' || CAST(total AS BIGINT) || ',"entities":' || k || '}}' AS attributes
  FROM b JOIN e ON b.id = e.dst JOIN nation ON e.src = 'n' || n_nationkey WHERE r = 1""")
def loc03_localize(spark, sf_dir):
    members = v.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("ref_id"), F.lit("service").alias("kind"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("id"))
    roots = v.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("start"))
    e = v.edges(spark, sf_dir)
    out = _valid(incidents.localize(members, incidents.topology_path(e, roots, 5), incidents.topology_neighbors(e), "2024-02-01"), "event.localized.v1")
    main = F.concat_ws(":", "location.primary.kind", "location.primary.id")
    return out.select("ref_id", v.stamp("localized_at").alias("localized_at"), main.alias("primary"), F.round("confidence", 6).alias("confidence"), _shown(F.col("location.neighbors")).alias("near"), _shown(F.col("location.path")).alias("path"), "attributes")


@query(f"""WITH g AS ({G}) SELECT 'story-' || group_id AS story_id, {STAMP.format("max(tm)")} AS created_at, arg_max(severity, rank) || ' in ' || min(source) AS title, arg_max(severity, rank) AS severity, count(*) || ' records of 1 entities since ' || {STAMP.format("min(tm)")} AS summary,
  string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS refs, string_agg(DISTINCT kind || ':' || id, ',' ORDER BY kind || ':' || id) AS entities, min(source) AS source, '{{"records":' || count(*) || ',"sources":' || count(DISTINCT source) || '}}' AS attributes FROM g GROUP BY group_id""")
def sto01_derive_stories(spark, sf_dir):
    out = _valid(incidents.derive_stories(_groups(spark, sf_dir)), "derived.stories.v1")
    return out.select("story_id", v.stamp("created_at").alias("created_at"), "title", "severity", "summary", F.array_join("evidence_refs", ",").alias("refs"), _shown(F.col("entities")).alias("entities"), F.col("labels")["source"].alias("source"), "attributes")


@query("""WITH n AS (SELECT event_type AS source, date_trunc('day', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM n WINDOW w AS (PARTITION BY source ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT source, strftime(bucket, '%Y-%m-%d') AS bucket, n, round((n - mean) / sd, 6) AS z FROM w WHERE sd > 0 AND abs((n - mean) / sd) >= 1.0""")
def ano01_rate_anomalies(spark, sf_dir):
    logs = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    return incidents.rate_anomalies(logs, "1 day", 7, 1.0).select("source", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n", F.round("z", 6).alias("z"))


ANO2 = """WITH m AS (SELECT event_id AS id, event_type AS source, value, median(value) OVER (PARTITION BY event_type) AS med FROM events), d AS (SELECT source, median(abs(value - med)) AS mad FROM m GROUP BY source)
  SELECT id, m.source, value, round(0.6745 * (value - med) / mad, 6) AS z FROM m JOIN d ON m.source = d.source WHERE mad > 0 AND abs(0.6745 * (value - med) / mad) >= 3.0"""


@query(ANO2)
def ano02_value_anomalies(spark, sf_dir):
    logs = v.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), "value")
    return incidents.value_anomalies(logs, 3.0).withColumn("z", F.round("z", 6))


@query("SELECT event_type AS source, event_type || ' by u<num> value <num>' AS template, count(*) AS n, count(*) <= 2010 AS rare FROM events GROUP BY event_type")
def ano03_log_templates(spark, sf_dir):
    return incidents.log_templates(v.logs(spark, sf_dir), 2010)


@query("SELECT t AS template, count(*) AS n FROM (SELECT event_type || ' by u<num> value <num>' AS t FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') WHERE t NOT IN (SELECT event_type || ' by u<num> value <num>' FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' AND event_type NOT IN ('error', 'view')) GROUP BY t")
def ano04_novel_templates(spark, sf_dir):
    logs = v.logs(spark, sf_dir)
    return incidents.novel_templates(logs.where("observed_at >= '2024-01-10 00:00:00'"), logs.where("observed_at < '2024-01-10 00:00:00' AND source NOT IN ('error', 'view')"))


@query(f"SELECT 'a' || id AS anomaly_id, 'mad' AS detector, round(1 - 1 / (1 + abs(z)), 6) AS score, 'log-' || id AS refs FROM ({ANO2})")
def ano05_emit_log_anomalies(spark, sf_dir):
    logs = v.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), "value")
    found = incidents.value_anomalies(logs, 3.0).withColumn("z", F.round("z", 6)).select(F.concat(F.lit("a"), F.col("id")).alias("anomaly_id"), F.lit("2024-02-01").cast("timestamp").alias("at"), "z", F.array(F.concat(F.lit("log-"), F.col("id"))).alias("ref_ids"))
    return incidents.emit_log_anomalies(found, "mad").select("anomaly_id", "detector", F.round("score", 6).alias("score"), F.array_join("ref_ids", ",").alias("refs"))


def _vectors(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


TOPK = """WITH e AS (SELECT vec_id AS id, embedding AS x FROM embeddings), s AS (SELECT q.id AS ref_id, e.id, greatest(0.0, round(list_cosine_similarity(CAST(q.x AS DOUBLE[]), CAST(e.x AS DOUBLE[])), 9)) AS score FROM e JOIN e q ON q.id % 50 = 0 AND q.id <> e.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, id) AS rank FROM s) SELECT ref_id, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query("""WITH w AS (SELECT conv_id, turn, CAST('0x' || substr(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+'))), 1, 8) AS BIGINT) % 256 AS dim FROM conversations), tf AS (SELECT conv_id, turn, dim, count(*) AS tf FROM w GROUP BY ALL), i AS (SELECT dim, ln(((SELECT count(*) FROM conversations) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY dim),
  x AS (SELECT conv_id, turn, dim, tf * idf AS x FROM tf JOIN i USING (dim)) SELECT conv_id, turn, 'hashed-tfidf-256' AS model, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 6) AS x FROM x QUALIFY round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 6) <> 0""")
def sim01_embed_text(spark, sf_dir):
    """The components of the vectors that are not zero."""
    out = incidents.embed_text(v.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")
    return out.select("conv_id", "turn", "model", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6)).where("x <> 0")


@query(TOPK)
def sim02_similar_topk(spark, sf_dir):
    """Queries: every row whose id is divisible by 50, against all rows."""
    d = _vectors(spark, sf_dir)
    return incidents.similar_topk(d, d.where("id % 50 = 0"), 5).withColumn("score", F.round("score", 5))


@query()
def sim03_similar_topk_approx(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    return incidents.similar_topk_approx(d, d.where("id % 50 = 0"), 5, 1.3, bucket=4.0, tables=8)


@query(f"""SELECT CAST(ref_id AS VARCHAR) AS ref_id, '2024-01-01 00:00:00' AS computed_at, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS neighbors, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks, round(sum(score), 3) AS total, '{{"k":' || count(*) || '}}' AS attributes FROM ({TOPK}) GROUP BY ref_id""")
def sim04_emit_similar_incidents(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    out = _valid(incidents.emit_similar_incidents(incidents.similar_topk(d, d.where("id % 50 = 0"), 5), "vectors", "2024-01-01"), "similar.incidents.v1")
    each = lambda f: F.array_join(F.transform("neighbors", f), ",")
    total = F.aggregate("neighbors", F.lit(0.0), lambda s, n: s + F.round(n["score"], 5))
    return out.select("ref_id", v.stamp("computed_at").alias("computed_at"), each(lambda x: x["id"]).alias("neighbors"), each(lambda x: F.get_json_object(x["features"], "$.rank")).alias("ranks"), F.round(total, 3).alias("total"), "attributes")


@query("SELECT user_id AS doc_id, round(sum(value * (event_id % 2)) / greatest(sum(event_id % 2), 1), 6) AS x0, round(sum(event_id * (event_id % 2)) / greatest(sum(event_id % 2), 1), 6) AS x1 FROM events GROUP BY user_id")
def cce01_pool_embeddings(spark, sf_dir):
    t = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 2).alias("mask"), F.array("value", F.col("event_id").cast("double")).alias("vector"))
    out = contenders.pool_embeddings(t)
    return out.select("doc_id", F.round(F.col("embedding")[0], 6).alias("x0"), F.round(F.col("embedding")[1], 6).alias("x1"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def cce02_score_batches(spark, sf_dir):
    def load():
        def infer(pdf):
            return pdf[["vec_id"]].assign(total=[round(float(sum(map(float, x))), 4) for x in pdf["embedding"]])

        return infer

    return contenders.score_batches(v.table(spark, sf_dir, "embeddings"), load, "vec_id long, total double", 32)


@query("SELECT vec_id, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS pred FROM embeddings")
def cce03_argmax_label(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select("vec_id", contenders.argmax_label(F.slice("embedding", 1, 10)).alias("pred"))


@query("WITH p AS (SELECT 'm' || k AS model, label, list_position(embedding[k:k + 9], list_max(embedding[k:k + 9])) - 1 AS pred FROM embeddings, (VALUES (1), (11)) t(k)) SELECT model, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM p GROUP BY model")
def cce04_accuracy(spark, sf_dir):
    d = _vectors(spark, sf_dir)
    preds = [d.select(F.lit(f"m{k}").alias("model"), "id", contenders.argmax_label(F.slice("embedding", k, 10)).alias("pred")) for k in (1, 11)]
    return contenders.accuracy(preds[0].unionByName(preds[1]), d.select("id", "label")).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT label, round(avg(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[33:64] AS DOUBLE[]))), 5) AS cosine FROM embeddings GROUP BY label")
def cce05_cosine_metric(spark, sf_dir):
    d = _vectors(spark, sf_dir).select("label", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return contenders.cosine_metric(d, ["label"], "a", "b").withColumn("cosine", F.round("cosine", 5))


@query("""WITH t AS (SELECT role, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations), w AS (SELECT role, list_filter(string_split_regex(coalesce(r, ''), '\\s+'), lambda x: x <> '') AS r, list_filter(string_split_regex(h, '\\s+'), lambda x: x <> '') AS h FROM t WHERE h IS NOT NULL),
  e AS (SELECT role, len(r) AS words, list_reduce(r, lambda row, w: list_reduce(range(1, len(h) + 1), lambda done, j: list_append(done, least(done[-1] + 1, row[j + 1] + 1, row[j] + CASE WHEN h[j] = w THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, len(h) + 1))[-1] AS edits FROM w)
  SELECT role, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(words) AS BIGINT) AS words, round(sum(edits) / greatest(sum(words), 1), 6) AS wer FROM e GROUP BY role""")
def cce06_wer(spark, sf_dir):
    """Word error rate of each whole turn against the turn after it in its conversation, by role."""
    from pyspark.sql.window import Window

    c = v.table(spark, sf_dir, "conversations")
    d = c.withColumn("hyp", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("hyp IS NOT NULL")
    return contenders.wer(d.select("role", F.col("text").alias("r"), F.col("hyp").alias("h")), ["role"], "r", "h").withColumn("wer", F.round("wer", 6))


@query("SELECT role, round(avg(CASE WHEN trim(text) = trim(lower(text)) THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM conversations GROUP BY role")
def cce07_exact_match(spark, sf_dir):
    d = v.table(spark, sf_dir, "conversations").withColumn("low", F.lower("text"))
    return contenders.exact_match(d, ["role"], "low", "text").withColumn("exact_match", F.round("exact_match", 6))


@query("""WITH m AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS old, l_linestatus AS task, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2), p AS (SELECT task, 'q' AS metric, max(CASE WHEN old THEN q END) AS champion, max(CASE WHEN NOT old THEN q END) AS challenger, 0.002 AS threshold FROM m GROUP BY task UNION ALL SELECT task, 'd', max(CASE WHEN old THEN d END), max(CASE WHEN NOT old THEN d END), -0.00001 FROM m GROUP BY task)
  SELECT task, metric, round(challenger - champion, 6) AS delta, coalesce(CASE WHEN threshold < 0 THEN challenger - champion <= threshold ELSE challenger - champion >= threshold END, false) AS promote FROM p""")
def cce08_compare_contenders(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").withColumn("role", F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "champion").otherwise("challenger"))
    m = li.groupBy(F.col("l_linestatus").alias("task"), "role").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    m = m.unpivot(["task", "role"], ["q", "d"], "metric", "value")
    policy = spark.createDataFrame([(t, a, b) for t in "OF" for a, b in (("q", 0.002), ("d", -0.00001))], "task string, metric string, threshold double")
    return contenders.compare_contenders(m, policy).select("task", "metric", F.round("delta", 6).alias("delta"), "promote")


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 64")
def cce09_eval_sample(spark, sf_dir):
    return contenders.eval_sample(v.table(spark, sf_dir, "orders"), "o_orderkey", 64).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 700000 THEN 'champion' ELSE 'challenger' END AS model FROM orders")
def cce10_route_traffic(spark, sf_dir):
    return contenders.route_traffic(v.table(spark, sf_dir, "orders"), "o_custkey", {"champion": 0.7, "challenger": 0.3}).select("o_orderkey", "model")


@query("SELECT 'm' || (user_id % 3) AS model, event_type AS task, strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, round(avg(value), 6) AS reward, count(*) AS n FROM events GROUP BY ALL")
def cce11_online_rewards(spark, sf_dir):
    d = v.table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("task"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("reward"))
    return contenders.online_rewards(d, "1 day").withColumns({"bucket": F.date_format("bucket", "yyyy-MM-dd"), "reward": F.round("reward", 6)})


@query("WITH m AS (SELECT event_type AS task, 'm' || (user_id % 5) AS model, round(avg(value), 6) AS gain, round(stddev_pop(value), 6) AS loss FROM events GROUP BY ALL), u AS (SELECT task, model, 'gain' AS metric, gain AS value FROM m UNION ALL SELECT task, model, 'loss', loss FROM m) SELECT *, CAST(dense_rank() OVER (PARTITION BY task, metric ORDER BY CASE WHEN metric = 'loss' THEN value ELSE -value END) AS INTEGER) AS rank FROM u")
def cce12_leaderboard(spark, sf_dir):
    m = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model")).agg(F.round(F.avg("value"), 6).alias("gain"), F.round(F.stddev_pop("value"), 6).alias("loss"))
    return contenders.leaderboard(m.unpivot(["task", "model"], ["gain", "loss"], "metric", "value"), ["loss"])



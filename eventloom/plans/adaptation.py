"""Queries of adaptation programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_folder, remove_at_end
from ..operators import adaptation as ad
from . import views as v

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _spans(spark, sf_dir):
    """Gold and predicted spans: line items by return flag (gold) and by line status (predicted), with ship year as topic."""
    li = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("topic"), "l_returnflag", "l_linestatus", "l_quantity")
    gold = li.where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("type"), "topic", "l_orderkey", "l_linenumber")
    pred = li.where("l_quantity > 20").select(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("A").alias("type"), "topic", "l_orderkey", "l_linenumber")
    return gold, pred


PRF = """WITH li AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS topic, l_returnflag, l_linestatus, l_quantity FROM lineitem), g AS (SELECT DISTINCT l_returnflag AS type, topic, l_orderkey, l_linenumber, 1 AS g FROM li WHERE l_returnflag <> 'N'),
  p AS (SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'A' END AS type, topic, l_orderkey, l_linenumber, 1 AS p FROM li WHERE l_quantity > 20), m AS (SELECT type, topic, g, p FROM g FULL OUTER JOIN p USING (type, topic, l_orderkey, l_linenumber)),
  n AS (SELECT type, topic, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM m GROUP BY type, topic)
  SELECT type, CAST(topic AS INTEGER) AS topic, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM n"""


def _prf(spark, sf_dir):
    gold, pred = _spans(spark, sf_dir)
    return ad.prf(gold, pred, ["l_orderkey", "l_linenumber"], ["type", "topic"])


@query("SELECT 'p' || p_size AS id, name FROM (SELECT p_size, CASE WHEN p_partkey % 7 = 0 THEN '__missing__' ELSE p_brand END AS name FROM part) WHERE name <> 'Brand#11' AND name <> 'Brand#12'")
def adp01_unregistered_metrics(spark, sf_dir):
    m = F.struct(F.when(F.col("p_partkey") % 14 == 0, F.lit("")).when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("name"))
    programs = v.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_size")).alias("id"), F.array(m).alias("metrics"))
    return ad.unregistered_metrics(programs, spark.createDataFrame([("Brand#11",), ("Brand#12",)], "id string"))


@query(f"SELECT type, topic, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({PRF})")
def adp02_entity_prf(spark, sf_dir):
    return _prf(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH g AS (SELECT DISTINCT l_returnflag AS type, l_partkey, l_suppkey FROM lineitem WHERE l_tax > 0.04), p AS (SELECT DISTINCT l_returnflag AS type, l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.04)
  SELECT type, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a) AS fp, count(*) FILTER (WHERE NOT b) AS fn FROM (SELECT type, bool_or(src = 0) AS a, bool_or(src = 1) AS b FROM (SELECT *, 0 AS src FROM g UNION ALL SELECT *, 1 FROM p) GROUP BY type, l_partkey, l_suppkey) GROUP BY type""")
def adp03_relation_prf(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "type")
    return ad.relation_prf(li.where("l_tax > 0.04"), li.where("l_discount > 0.04"), ["l_partkey", "l_suppkey"], ["type"]).select("type", "tp", "fp", "fn")


@query(f"""WITH p AS ({PRF}), t AS (SELECT type, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM p GROUP BY type) SELECT 'macro' AS how, 'all' AS type, round(avg(f1), 6) AS value FROM p UNION ALL SELECT 'micro', 'all', round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM p
  UNION ALL SELECT 'weighted', 'all', round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) FROM p UNION ALL SELECT 'per_class', type, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) FROM t""")
def adp04_aggregate_metric(spark, sf_dir):
    p = _prf(spark, sf_dir)
    each = [ad.aggregate_metric(p, how).select(F.lit(how).alias("how"), F.lit("all").alias("type"), "value") for how in ("macro", "micro", "weighted")]
    each.append(ad.aggregate_metric(p, "per_class", ["type"]).select(F.lit("per_class").alias("how"), "type", "value"))
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).withColumn("value", F.round("value", 6))


@query(f"""WITH p AS ({PRF}), t AS (SELECT type, round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 6) AS f FROM p GROUP BY type) SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS overall, (SELECT f FROM t WHERE type = 'A') AS f_a, (SELECT f FROM t WHERE type = 'R') AS f_r FROM p""")
def adp05_f1_shape(spark, sf_dir):
    out = ad.f1_shape(_prf(spark, sf_dir), "type", "topic")
    return out.select(F.round("overall", 6).alias("overall"), F.round(F.col("per_type")["A"], 6).alias("f_a"), F.round(F.col("per_type")["R"], 6).alias("f_r"))


@query("SELECT source, lang, round(median(n_chars / 900.0), 6) AS minutes, count(*) AS n FROM documents GROUP BY source, lang")
def adp06_annotation_minutes(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").withColumn("minutes", F.col("n_chars") / 900.0)
    return ad.annotation_minutes(d, ["source", "lang"]).withColumn("minutes", F.round("minutes", 6))


@query("""WITH w AS (SELECT event_type AS topic, CAST(date_diff('week', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS win, 't' || (user_id % 20) AS term, sum(value) AS weight FROM events GROUP BY 1, 2, 3), a AS (SELECT DISTINCT topic, win FROM w), pr AS (SELECT a.topic, a.win FROM a JOIN a b ON a.topic = b.topic AND a.win = b.win + 1),
  t AS (SELECT pr.topic, pr.win, x.term FROM pr JOIN (SELECT DISTINCT topic, win, term FROM w UNION SELECT topic, win + 1, term FROM w) x USING (topic, win)), m AS (SELECT t.topic, t.win, t.term, coalesce(c.weight, 0) + 1e-6 AS p, coalesce(b.weight, 0) + 1e-6 AS q FROM t LEFT JOIN w c ON c.topic = t.topic AND c.win = t.win AND c.term = t.term LEFT JOIN w b ON b.topic = t.topic AND b.win = t.win - 1 AND b.term = t.term),
  s AS (SELECT topic, win, p / sum(p) OVER (PARTITION BY topic, win) AS p, q / sum(q) OVER (PARTITION BY topic, win) AS q FROM m) SELECT topic, win AS "window", round(sum(p * ln(p / q)), 6) AS kl FROM s GROUP BY topic, win""")
def adp07_topic_drift_kl(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    week = F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    w = e.select(F.col("event_type").alias("topic"), week.alias("window"), F.concat(F.lit("t"), F.col("user_id") % 20).alias("term"), F.col("value").alias("weight"))
    return ad.topic_drift_kl(w).withColumn("kl", F.round("kl", 6))


@query("SELECT event_type AS metric, event_id, value FROM events WHERE (event_type = 'click' AND (value < 0 OR value > 50)) OR (event_type = 'view' AND value > 60) OR (event_type = 'error' AND value < 1)")
def adp08_metric_range_check(spark, sf_dir):
    reg = spark.createDataFrame([("click", [0.0, 50.0]), ("view", [None, 60.0]), ("error", [1.0, None])], "id string, range array<double>")
    return ad.metric_range_check(v.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "event_id", "value"), reg).select("metric", "event_id", "value")


def _delta(spark, sf_dir):
    """Mean price by priority before and from 1998."""
    o = v.table(spark, sf_dir, "orders")
    mean = lambda d: d.groupBy(F.col("o_orderpriority").alias("program"), F.concat(F.lit("price.mean."), F.col("o_orderstatus")).alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return ad.metric_delta(mean(o.where(F.col("o_orderdate") < cut)), mean(o.where(F.col("o_orderdate") >= cut)), ["program", "metric"])


DELTA = """WITH m AS (SELECT o_orderpriority AS program, 'price.mean.' || o_orderstatus AS metric, o_orderdate < TIMESTAMP '1998-01-01' AS old, round(avg(o_totalprice), 4) AS x FROM orders GROUP BY 1, 2, 3) SELECT program, metric, max(CASE WHEN old THEN x END) AS baseline, max(CASE WHEN NOT old THEN x END) AS treatment, max(CASE WHEN NOT old THEN x END) - max(CASE WHEN old THEN x END) AS delta FROM m GROUP BY program, metric"""


@query(f"SELECT program, metric, baseline, treatment, round(delta, 3) AS delta FROM ({DELTA})")
def adp09_metric_delta(spark, sf_dir):
    return _delta(spark, sf_dir).withColumn("delta", F.round("delta", 3))


def _rules(spark):
    rows = [(p, *r) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none") for r in (("promote_if", "price.mean.F.delta_gte", 0.0), ("promote_if", "price.mean.O.min_gte", 1000.0), ("rollback_if", "price.mean.P.delta_lt", -2000.0))]
    return spark.createDataFrame(rows, "program string, side string, key string, threshold double")


@query(f"""WITH d AS ({DELTA}), p AS (SELECT DISTINCT program FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('none')) t(program)), x AS (SELECT p.program, count(treatment) AS n, bool_or(metric = 'price.mean.P' AND delta < -2000.0) AS back, bool_or(metric = 'price.mean.F' AND delta >= 0) AND bool_or(metric = 'price.mean.O' AND treatment >= 1000.0) AS up FROM p LEFT JOIN d USING (program) GROUP BY p.program)
  SELECT program, CASE WHEN n = 0 THEN 'none' WHEN coalesce(back, false) THEN 'rollback' WHEN coalesce(up, false) THEN 'promote' ELSE 'hold' END AS decision FROM x""")
def adp10_decide(spark, sf_dir):
    return ad.decide(_delta(spark, sf_dir).select("program", "metric", F.col("treatment").alias("value"), "delta"), _rules(spark))


@query(f"SELECT program, metric, treatment AS value FROM ({DELTA}) WHERE treatment < 250000.0")
def adp11_metric_constraints(spark, sf_dir):
    m = _delta(spark, sf_dir).select("program", "metric", F.col("treatment").alias("value"))
    return ad.metric_constraints(m, m.select("program", "metric").distinct().withColumn("min_overall", F.lit(250000.0))).select("program", "metric", "value")


def _topics(spark, sf_dir, method="lda"):
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, ad.fit_topics(docs, method, k=4)


@query()
def adp12_13_topics_lda(spark, sf_dir):
    _, (vectors, _, model) = _topics(spark, sf_dir)
    return ad.topic_membership(vectors, model, "lda_theta").withColumn("membership", F.round("membership", 4))


@query()
def adp13_topics_lsa(spark, sf_dir):
    _, (vectors, _, axes) = _topics(spark, sf_dir, "lsa")
    return ad.topic_membership(vectors, axes, "lsa_cosine").withColumn("membership", F.round("membership", 4))


@query()
def adp12_13_topics_lsi(spark, sf_dir):
    _, (vectors, _, axes) = _topics(spark, sf_dir, "lsi")
    return ad.topic_membership(vectors, axes, "lsi_cosine").withColumn("membership", F.round("membership", 4))


@query()
def adp14_topic_signature(spark, sf_dir):
    docs, (vectors, words, model) = _topics(spark, sf_dir)
    out = ad.topic_signature(model, words, docs, ad.topic_membership(vectors, model, "lda_theta"), 5)
    return out.select("topic_id", F.array_join(F.transform("top_terms", lambda x: x["term"]), ",").alias("terms"), F.array_join("top_phrases", ",").alias("phrases"))


def _membership(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode(F.slice("embedding", 1, 8)).alias("topic_id", "x")).select("doc_id", "topic_id", F.abs(F.col("x").cast("double")).alias("membership"))


MEMBERS = "SELECT vec_id AS doc_id, CAST(i - 1 AS INTEGER) AS topic_id, abs(CAST(embedding[i] AS DOUBLE)) AS membership FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i)"


@query(f"SELECT doc_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY membership DESC, topic_id) AS r FROM ({MEMBERS})) WHERE r <= 2 AND membership >= 0.15")
def adp15_activation_gate(spark, sf_dir):
    return ad.activation_gate(_membership(spark, sf_dir), 0.15, 2)


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src1')")
def adp16_applies_to(spark, sf_dir):
    return ad.applies_to(v.table(spark, sf_dir, "documents"), {"lang": ["en", "fr"], "source": ["src0", "src1"], "doc_id": None}).select("doc_id")


@query("""SELECT p_partkey AS "key", CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'c' WHEN p_partkey % 3 = 0 THEN 'b' WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'd' END AS payload FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 7 = 0""")
def adp17_compose_spaces(spark, sf_dir):
    p = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    layer = lambda n, x: p.where(F.col("key") % n == 0).withColumn("payload", F.lit(x))
    only = p.where("key % 5 = 0 AND (key % 2 = 0 OR key % 3 <> 0)").withColumn("payload", F.lit("c"))
    return ad.compose_spaces([(layer(2, "a"), "merge"), (layer(3, "b"), "merge"), (only, "overrides_only"), (layer(7, "d"), "append_only")])


def _claims(spark, sf_dir):
    return v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("layer"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("artifact_id"), F.col("l_returnflag").alias("payload"))


CLAIMS = "SELECT l_orderkey AS k, l_linenumber AS layer, l_orderkey || ':' || l_linenumber AS artifact_id, l_returnflag AS payload FROM lineitem"


@query(f"""WITH c AS ({CLAIMS}), a AS (SELECT 'deny' AS strategy, k, max(payload) AS payload FROM c GROUP BY k HAVING count(DISTINCT payload) = 1), b AS (SELECT 'vote' AS strategy, k, payload FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, layer DESC, payload) AS r FROM (SELECT k, payload, count(*) AS n, max(layer) AS layer FROM c GROUP BY k, payload)) WHERE r = 1),
  d AS (SELECT 'ranked' AS strategy, k, payload FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer DESC, artifact_id DESC, payload DESC) AS r FROM c) WHERE r = 1), e AS (SELECT 'pinned' AS strategy, k, payload FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN artifact_id IN ('1:1', '2:1', '3:1') THEN 1 ELSE 0 END DESC, layer DESC, artifact_id DESC, payload DESC) AS r FROM c) WHERE r = 1)
  SELECT strategy, k AS "key", payload FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e)""")
def adp18_resolve_conflicts(spark, sf_dir):
    c = _claims(spark, sf_dir).withColumn("artifact_id", F.col("artifact_id"))
    # one artifact per key and layer: of repeated ones the greatest payload
    one = c.groupBy("key", "layer", "artifact_id").agg(F.max("payload").alias("payload"))
    tag = lambda name, d: d.select(F.lit(name).alias("strategy"), "key", "payload")
    return tag("deny", ad.resolve_conflicts(c, "deny_on_conflict")).unionByName(tag("vote", ad.resolve_conflicts(c, "vote"))).unionByName(tag("ranked", ad.resolve_conflicts(one, "ranked_layers"))).unionByName(tag("pinned", ad.resolve_conflicts(one, "pinned_overrides", ["1:1", "2:1", "3:1"])))


@query("""SELECT plan_id, 'c' || c_custkey AS principal FROM customer, (VALUES ('basic', 'free', 0), ('mid', 'premium', 1), ('top', 'enterprise', 2)) t(plan_id, min_plan, n) WHERE c_nationkey % 3 >= n AND CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END >= n""")
def adp19_entitled(spark, sf_dir):
    plans = spark.createDataFrame([("basic", [], "free"), ("mid", ["read"], "premium"), ("top", ["read", "write"], "enterprise")], "plan_id string, required_actions array<string>, min_plan string")
    c = v.table(spark, sf_dir, "customer")
    acts = F.when(F.col("c_nationkey") % 3 == 2, F.array(F.lit("read"), F.lit("write"))).when(F.col("c_nationkey") % 3 == 1, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>"))
    level = F.when(F.col("c_mktsegment") == "BUILDING", "enterprise").when(F.col("c_mktsegment") == "MACHINERY", "premium").otherwise("free")
    return ad.entitled(plans, c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("principal"), acts.alias("actions"), level.alias("plan")))


ARTIFACTS = "SELECT 'art:' || p_size AS id, (p_partkey % 3) || '.' || (p_partkey % 12) || '.' || p_partkey AS version, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'banned' ELSE 'approved' END AS status, p_brand, p_type FROM part"


def _artifacts(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("art:"), F.col("p_size")).alias("id"), F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), (F.col("p_partkey") % 12).cast("string"), F.col("p_partkey").cast("string")).alias("version"), "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "banned").otherwise("approved").alias("status"), "p_brand", "p_type")


@query(f"SELECT id, version, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey % 3 DESC, p_partkey % 12 DESC, p_partkey DESC) AS r FROM ({ARTIFACTS}) WHERE status = 'approved') WHERE r = 1")
def adp20_current_artifacts(spark, sf_dir):
    return ad.current_artifacts(_artifacts(spark, sf_dir)).select("id", "version", "p_partkey")


@query("SELECT CASE WHEN p_partkey % 10 <> 0 THEN 'ok' ELSE 'bad' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def adp21_verify_digests(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    good = F.concat(F.lit("sha256:"), F.sha2(F.col("p_name").cast("binary"), 256))
    return ad.verify_digests(p.select(F.col("p_name").alias("payload"), F.when(F.col("p_partkey") % 20 == 0, F.lit(None)).when(F.col("p_partkey") % 10 == 0, "sha256:0").otherwise(good).alias("digest")))


WORDS = "SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents"


@query(f"SELECT doc_id, w AS term, count(*) AS n FROM ({WORDS}) WHERE w IN ('the', 'token', 'license', 'idiot', 'une') GROUP BY doc_id, w")
def adp22_apply_dictionary(spark, sf_dir):
    terms = spark.createDataFrame([("the",), ("token",), ("License",), ("idiot",), ("une",), ("no such term here",)], "term string")
    return ad.apply_dictionary(v.table(spark, sf_dir, "documents").select("doc_id", "text"), terms)


@query("SELECT doc_id, 'number' AS rule, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS match FROM documents UNION ALL SELECT doc_id, 'mail', unnest(regexp_extract_all(text, '[a-z]+@[a-z]+')) FROM documents")
def adp23_apply_regex_rules(spark, sf_dir):
    return ad.apply_regex_rules(v.table(spark, sf_dir, "documents").select("doc_id", "text"), {"number": "[0-9]{4,}", "mail": "[a-z]+@[a-z]+"})


@query("""WITH t AS (SELECT doc_id, lang, w, i FROM (SELECT doc_id, lang, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS x FROM documents))), g AS (SELECT a.lang, a.w || ' ' || b.w AS gram FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1), n AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY lang, gram)
  SELECT lang, gram, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM n) WHERE rank <= 5""")
def adp24_ngram_rankings(spark, sf_dir):
    return ad.ngram_rankings(v.table(spark, sf_dir, "documents").select("lang", "text"), "lang", 2, 5)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS type, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS unknown FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def adp25_patch_taxonomy(spark, sf_dir):
    patch = spark.createDataFrame([("BUILDING", "HOUSING"), ("AUTOMOBILE", None)], "type string, to string")
    return ad.patch_taxonomy(v.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type"), "c_custkey"), patch, ["HOUSING", "MACHINERY"])


@query("SELECT 's' || s_suppkey AS artifact, 'n' || s_nationkey AS ancestor, 1 AS distance FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation")
def adp26_artifact_lineage(spark, sf_dir):
    return ad.artifact_lineage(v.edges(spark, sf_dir).select(F.col("dst").alias("artifact"), F.col("src").alias("input")))


@query("""WITH l AS (SELECT 's' || s_suppkey AS artifact, 'n' || s_nationkey AS ancestor, 1 AS distance FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation),
  m AS (SELECT 'n' || c_nationkey AS ancestor, 'run-' || c_custkey AS run_id, 'balance' AS metric, c_acctbal AS value FROM customer)
  SELECT l.*, run_id, metric, value FROM l LEFT JOIN m USING (ancestor)""")
def adp26_lineage_metrics(spark, sf_dir):
    runs = v.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("artifact"), F.concat(F.lit("run-"), F.col("c_custkey")).alias("run_id"), F.lit("balance").alias("metric"), F.col("c_acctbal").alias("value"))
    return ad.artifact_lineage(v.edges(spark, sf_dir).select(F.col("dst").alias("artifact"), F.col("src").alias("input")), runs)


@query(f"SELECT p_brand, status, count(*) AS n, CAST(grouping(p_brand, status) AS BIGINT) AS level FROM ({ARTIFACTS}) GROUP BY CUBE (p_brand, status)")
def adp27_artifact_rollup(spark, sf_dir):
    return ad.artifact_rollup(_artifacts(spark, sf_dir), ["p_brand", "status"])


@query("SELECT 'prog:1' AS program, CASE WHEN source IN ('src1', 'src2') THEN 'train' ELSE 'dev' END AS split, doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT 'prog:2', 'test', doc_id FROM documents WHERE source = 'src1'")
def adp28_split_datasets(spark, sf_dir):
    programs = spark.createDataFrame([("prog:1", {"train": ["src1", "src2"], "dev": ["src3"]}), ("prog:2", {"test": ["src1"]})], "id string, datasets map<string,array<string>>")
    return ad.split_datasets(programs, v.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset")))


@query("SELECT 'p' || (o_custkey % 50) AS id, count(*) AS n, round(avg((o_orderkey % 90) * 60.0), 6) AS mean_s, count(*) FILTER (WHERE o_orderstatus = 'F') AS promote, count(*) FILTER (WHERE o_orderstatus = 'O') AS hold, count(*) FILTER (WHERE o_orderstatus = 'P') AS rollback, CAST(0 AS BIGINT) AS none, CAST(0 AS BIGINT) AS n_queued, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_running, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_failed FROM orders GROUP BY 1")
def adp29_program_runs(spark, sf_dir):
    return ad.program_runs(_programs(spark, sf_dir)).withColumn("mean_s", F.round("mean_s", 6))


def _programs(spark, sf_dir):
    r = v.runs(spark, sf_dir)
    decision = F.when(F.col("status") == "completed", "promote").when(F.col("status") == "running", "hold").otherwise("rollback")
    return r.select(F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("id"), F.array(F.struct("run_id", "status", "started_at", "finished_at", decision.alias("decision"))).alias("runs"))


@query("SELECT 'p' || (o_custkey % 50) AS id, 'run-' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CASE o_orderstatus WHEN 'F' THEN 'promote' WHEN 'O' THEN 'hold' ELSE 'rollback' END AS decision, CAST((o_orderkey % 90) * 60 AS BIGINT) AS seconds FROM orders")
def adp29_flat_runs(spark, sf_dir):
    return ad.flat_runs(_programs(spark, sf_dir))


@query(f"SELECT 'plan' || program AS plan_id, round(delta, 3) AS gain, coalesce(delta >= 100.0, false) AS met FROM ({DELTA}) WHERE metric = 'price.mean.F'")
def adp30_plan_objective_met(spark, sf_dir):
    d = _delta(spark, sf_dir)
    plans = d.where("metric = 'price.mean.F'").select(F.concat(F.lit("plan"), F.col("program")).alias("plan_id"), "program", F.col("metric").alias("primary_metric"), F.lit(100.0).alias("target_gain"))
    return ad.plan_objective_met(d.select("program", "metric", "delta"), plans).select("plan_id", F.round("gain", 3).alias("gain"), "met")


CENTROIDS = f"WITH m AS ({MEMBERS}), e AS (SELECT vec_id AS doc_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) SELECT topic_id, dim, round(sum(x * membership) / sum(membership), 5) AS x FROM m JOIN e USING (doc_id) GROUP BY topic_id, dim"


def _centroids(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ad.topic_centroids(_membership(spark, sf_dir).withColumnRenamed("doc_id", "id"), e)


@query(CENTROIDS)
def adp31_topic_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).withColumn("x", F.round("x", 5))


@query(f"SELECT topic_id, 'space-1/' || topic_id AS ref, CAST(dim AS INTEGER) AS dim, x FROM ({CENTROIDS})")
def adp31_centroid_refs(spark, sf_dir):
    """The centroids stored as a topic space, and read again through their references."""
    path = remove_at_end(spark, new_folder(spark, "centroids"))
    found = ad.read_centroids(spark, ad.store_centroids(_centroids(spark, sf_dir), path, "space-1"))
    return found.select("topic_id", F.substring_index("centroid_embedding_ref", "#", -1).alias("ref"), F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 5))

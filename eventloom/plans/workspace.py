"""Queries of search, fleets, carriers and training sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import new_folder, remove_at_end
from ..operators import fleet, search
from . import views as v

Q, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _docs(spark, sf_dir):
    """Documents as search results: kind from the language, title and snippet from the text."""
    kind = F.when(F.col("lang") == "en", "web_doc").when(F.col("lang") == "fr", "entity").when(F.col("lang") == "de", "local_file").otherwise("collection")
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("kind"), F.col("source").alias("title"), F.col("text").alias("snippet"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10.0).alias("score"), "source")


DOCS = "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'web_doc' WHEN 'fr' THEN 'entity' WHEN 'de' THEN 'local_file' ELSE 'collection' END AS kind, source AS title, text AS snippet, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS score, source FROM documents"
SCORED = f"""SELECT id, kind, source, coalesce(score, 0.5) AS base, CASE WHEN contains(lower(title || ' ' || snippet), 'license') THEN 0.2 ELSE 0.0 END AS hit, CASE kind WHEN 'local_file' THEN -0.08 WHEN 'entity' THEN 0.06 WHEN 'web_doc' THEN 0.10 ELSE 0.08 END AS boost FROM ({DOCS})"""


@query(f"SELECT id, kind, round(greatest(0.0, least(1.0, base + hit + boost)), 6) AS score FROM ({SCORED})")
def sea01_search(spark, sf_dir):
    return search.search(_docs(spark, sf_dir), "License", "global").select("id", "kind", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(base, 6) AS base, round(hit, 6) AS hit, round(boost, 6) AS boost FROM ({SCORED})")
def sea09_explain_ranking(spark, sf_dir):
    out = search.score_parts(_docs(spark, sf_dir), "License", "global")
    return out.select("id", F.round("why.base", 6).alias("base"), F.round("why.match", 6).alias("hit"), F.round("why.boost", 6).alias("boost"))


def _lexical(queries: str, k: int) -> str:
    """(query_id, doc_id, score, rank) of BM25 over all documents for queries(query_id, text)."""
    return f"""WITH w AS (SELECT doc_id, unnest(x) AS term, len(x) AS len FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS x FROM documents)), q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ({queries})),
  s AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM documents), tf AS (SELECT doc_id, term, len, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  r AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY q.query_id, tf.doc_id)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= {k}"""


@query(f"SELECT query_id, doc_id, round(score, 5) AS score FROM ({_lexical('SELECT item_id AS query_id, text FROM benchmark', 10)})")
def sea02_lexical_search(spark, sf_dir):
    q = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.lexical_search(v.table(spark, sf_dir, "documents").select("doc_id", "text"), q, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def _vq(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


VEC = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(q.x, e.x), 9) AS score FROM e JOIN e q ON q.id % 50 = 0) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s"""


@query(f"SELECT query_id, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM ({VEC}) WHERE rank <= 5")
def sea03_vector_search(spark, sf_dir):
    return search.vector_search(*_vq(spark, sf_dir), 5).withColumn("score", F.round("score", 5))


#: Documents as a tree by halves of their ids, for the graph's part.
LINKS = "SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id // 2 <> doc_id"
_ASKED = "SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)"


@query(f"""WITH l AS (SELECT query_id, doc_id AS id, rank FROM ({_lexical(_ASKED, 20)})), a AS (SELECT query_id, id, rank FROM ({VEC}) WHERE rank <= 20), b AS (SELECT src, dst FROM ({LINKS}) UNION SELECT dst, src FROM ({LINKS})), o AS (SELECT query_id, dst AS node FROM ({_ASKED}) JOIN b ON src = query_id),
  h AS (SELECT query_id, node, 1 AS d FROM o UNION ALL SELECT query_id, b.dst, 2 FROM o JOIN b ON b.src = o.node), g AS (SELECT query_id, node AS id, row_number() OVER (PARTITION BY query_id ORDER BY min(d), node) AS rank FROM h WHERE node <> query_id GROUP BY query_id, node QUALIFY rank <= 20),
  s AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score, count(*) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM a UNION ALL SELECT * FROM g) GROUP BY query_id, id)
  SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def sea04_hybrid_search(spark, sf_dir):
    """Documents that have a vector and whose id is divisible by 50, against all documents: by their words, their vectors and their links."""
    docs, (e, vq) = v.table(spark, sf_dir, "documents"), _vq(spark, sf_dir)
    asked = docs.where("doc_id % 50 = 0").join(e.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "text")
    links = docs.select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst")).where("src <> dst")
    words = search.lexical_search(docs.select("doc_id", "text"), asked, 20).withColumnRenamed("doc_id", "id")
    return search.hybrid_search([words, search.vector_search(e, vq, 20), search.graph_ranking(links, asked, 2, 20)], 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH d AS (SELECT kind, source, CASE source WHEN 'src0' THEN 'trusted' WHEN 'src1' THEN 'untrusted' ELSE 'mixed' END AS trust FROM ({DOCS})) SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM d GROUP BY kind UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY source UNION ALL SELECT 'trust', trust, count(*) FROM d GROUP BY trust""")
def sea05_facets(spark, sf_dir):
    registry = spark.createDataFrame([("src0", "trusted"), ("src1", "untrusted")], "source string, trust string")
    return search.facets(search.annotate_trust(_docs(spark, sf_dir), registry), ["kind", "source", "trust"])


@query(f"SELECT id FROM ({DOCS}) ORDER BY coalesce(score, 0.5) DESC, id LIMIT 25 OFFSET 50")
def sea06_paginate(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return search.paginate(d.withColumn("score", F.coalesce("score", F.lit(0.5))), [F.desc("score"), F.col("id")], 3, 25).select("id")


@query(f"SELECT id FROM ({DOCS}) WHERE kind = 'entity' AND source = 'src0'")
def sea07_apply_filters(spark, sf_dir):
    return search.apply_filters(_docs(spark, sf_dir), {"kind": "entity", "source": "src0"}).select("id")


@query(f"SELECT trust, count(*) AS n FROM (SELECT CASE source WHEN 'src0' THEN 'trusted' WHEN 'src1' THEN 'untrusted' ELSE 'mixed' END AS trust FROM ({DOCS})) GROUP BY trust")
def sea08_annotate_trust(spark, sf_dir):
    reg = spark.createDataFrame([("src0", "trusted"), ("src1", "untrusted")], "source string, trust string")
    return search.annotate_trust(_docs(spark, sf_dir), reg).groupBy("trust").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT user_id AS usr, trim(CASE WHEN event_type = 'error' THEN '  ' ELSE ' ' || event_type || (event_id % 9) || ' ' END) AS q, ts FROM events), m AS (SELECT usr, q, max(ts) AS ts FROM q WHERE q <> '' GROUP BY usr, q)
  SELECT usr AS "user", q, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, q) AS rank FROM m) WHERE rank <= 20""")
def sea10_recent_queries(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    q = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.col("event_id") % 9, F.lit(" ")))
    return search.recent_queries(e.select(F.col("user_id").alias("user"), q.alias("q"), "ts")).drop("ts")


@query(f"SELECT id, '/entity/' || CASE kind WHEN 'entity' THEN 'company' WHEN 'local_file' THEN 'file' ELSE 'doc' END || '/' || id || '%3A%20' || id AS route FROM (SELECT id, kind FROM ({DOCS}))")
def sea11_entity_route(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("id").alias("key"), F.concat_ws(": ", "id", "id").alias("id"), "kind")
    return search.entity_route(d).select(F.col("key").alias("id"), "route")


@query("SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'allow' WHEN o_orderpriority = '2-HIGH' THEN 'allow' ELSE 'deny' END AS decision FROM orders")
def sea12_membrane_guard(spark, sf_dir):
    pol = spark.createDataFrame([("1-URGENT", "allow", ["F"]), ("2-HIGH", "allow", []), ("3-MEDIUM", "deny", [])], "action string, effect string, required array<string>")
    return search.membrane_guard(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("action"), F.array("o_orderstatus").alias("claims")), pol)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def sea13_audit_coverage(spark, sf_dir):
    ops = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderstatus") != "O").alias("mutates"))
    return search.audit_coverage(ops, v.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("trace_id"))).select(F.col("trace_id").alias("o_orderkey"))


@query("SELECT user_id % 10 AS principal, role, event_type AS outcome, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events, (VALUES ('r0'), ('r1')) t(role) WHERE role = 'r0' OR user_id % 2 = 0 GROUP BY ALL")
def sea14_governance_rollup(spark, sf_dir):
    roles = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("r0"), F.lit("r1"))).otherwise(F.array(F.lit("r0")))
    d = v.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("principal"), roles.alias("roles"), F.col("event_type").alias("outcome"), F.col("ts").alias("at"))
    return search.governance_rollup(d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'keep' WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'keep' END AS action, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 2 WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM documents""")
def sea15_ingest_documents(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    store = d.where("id % 2 = 0 OR id % 3 <> 0").withColumns({"version": F.lit(1), "hash": F.sha2(F.col("text").cast("binary"), 256)})
    batch = d.where("id % 2 = 1").withColumns({"text": F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "version": F.lit(2)})
    folder = remove_at_end(spark, new_folder(spark, "store"))
    search.ingest_into(store.drop("hash"), folder)
    acted = search.ingest_into(batch, folder)
    return spark.read.parquet(folder).join(acted, "id", "left").select("id", F.coalesce("action", F.lit("keep")).alias("action"), "version")


@query("SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def sea16_semantic_graph(spark, sf_dir):
    return search.semantic_graph(v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("entity")))


@query("SELECT 'r0' AS seed, 'r0' AS node, 0 AS distance UNION ALL SELECT 'r0', 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'r0', 's' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")
def sea17_k_hop(spark, sf_dir):
    return search.k_hop(v.edges(spark, sf_dir), spark.createDataFrame([("r0",)], "seed string"), 2)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'principal,locale' WHEN doc_id % 3 = 0 THEN 'principal' ELSE 'locale' END AS missing FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def sea18_envelope_check(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("trace_id"), F.when(F.col("doc_id") % 3 > 0, "p").alias("principal"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("locale"), F.lit("s").alias("schema_ref"))
    return search.envelope_check(d).select("doc_id", "missing")


@query("SELECT o_orderkey AS id, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag, l_linenumber) AS shown FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def sea19_provenance_panel(spark, sf_dir):
    e = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("quote"), F.lit("").alias("snapshot"))
    out = search.provenance_panel(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), e)
    return out.select("id", F.array_join(F.transform("evidence", lambda x: F.concat(x["source"], x["quote"])), ",").alias("shown"))


def _repos(spark, sf_dir):
    """Parts as repositories."""
    role = F.when(F.col("p_size") % 4 == 0, "component").when(F.col("p_size") % 4 == 1, "adapter").when(F.col("p_size") % 4 == 2, "third_party").otherwise("docs")
    path = F.concat(F.when(F.col("p_partkey") % 6 == 0, "elsewhere/").when(role == "component", "components/").when(role == "adapter", "adapters/").otherwise("third_party/"), F.col("p_partkey"))
    return v.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), role.alias("role"), path.alias("local_path"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("license"), F.array("p_type", "p_brand").alias("capabilities"), "p_partkey", "p_brand", "p_type")


REPOS = "SELECT 'p' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN 'component' WHEN 1 THEN 'adapter' WHEN 2 THEN 'third_party' ELSE 'docs' END AS role, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS license, p_partkey, p_brand, p_type FROM part"


def _lock(spark, sf_dir, n):
    p = v.table(spark, sf_dir, "part")
    return p.where(F.col("p_partkey") % n > 0).select(F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.concat(F.lit("r"), F.when(F.col("p_partkey") % 11 == 0, n).otherwise(0)).alias("rev"))


@query("SELECT 'p' || p_partkey AS name, p_partkey % 3 > 0 AND p_partkey % 4 > 0 AND p_partkey % 11 = 0 AS drift FROM part")
def wsp01_lock_drift(spark, sf_dir):
    return fleet.lock_drift(_repos(spark, sf_dir), _lock(spark, sf_dir, 3), _lock(spark, sf_dir, 4)).select("name", "drift")


@query("SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'MISSING' WHEN p_partkey % 2 = 0 THEN 'GIT' ELSE 'LOCAL' END AS status FROM part")
def wsp02_repo_status(spark, sf_dir):
    r = _repos(spark, sf_dir)
    return fleet.repo_status(r, r.where("p_partkey % 3 > 0").select("name", (F.col("p_partkey") % 2 == 0).alias("is_git"))).select("name", "status")


@query(f"SELECT 'only' AS how, name FROM ({REPOS}) WHERE name IN ('p1', 'p2') UNION ALL SELECT 'all', name FROM ({REPOS}) WHERE role = 'component' UNION ALL SELECT 'role', name FROM ({REPOS}) WHERE role = 'docs'")
def wsp03_select_targets(spark, sf_dir):
    r = _repos(spark, sf_dir)
    tag = lambda how, **kw: fleet.select_targets(r, **kw).select(F.lit(how).alias("how"), "name")
    return tag("only", only=["p1", "p2"], role="docs", every=True).unionByName(tag("all", every=True, role="docs")).unionByName(tag("role", role="docs")).unionByName(tag("none"))


@query("SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Makefile' WHEN p_partkey % 3 = 0 THEN 'Taskfile.yaml' WHEN p_partkey % 5 = 0 THEN 'scripts/build.sh' ELSE 'no contract' END AS contract FROM part")
def wsp04_task_contract(spark, sf_dir):
    r = _repos(spark, sf_dir)
    f = lambda n, path: r.where(F.col("p_partkey") % n == 0).select("name", F.lit(path).alias("path"))
    files = f(2, "Makefile").unionByName(f(3, "Taskfile.yaml")).unionByName(f(5, "scripts/build.sh")).unionByName(f(7, "scripts/test.sh"))
    return fleet.task_contract(r.select("name"), files, "build")


@query("""WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS position, CASE WHEN l_returnflag = 'A' THEN 'missing' WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'no contract' ELSE 'ran' END AS outcome, CASE WHEN l_returnflag = 'A' OR (l_linestatus = 'O' AND l_linenumber = 7) THEN 2 WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) % 3 ELSE 0 END AS c, l_partkey FROM lineitem) SELECT batch, coalesce(arg_max(c, position * 1000000 + l_partkey) FILTER (WHERE c <> 0), 0) AS exit_code, count(*) FILTER (WHERE outcome = 'ran' AND c = 0) AS n_ok, count(*) FILTER (WHERE outcome = 'ran' AND c <> 0) AS n_failed, count(*) FILTER (WHERE outcome = 'missing') AS n_missing, count(*) FILTER (WHERE outcome = 'no contract') AS n_no_contract FROM r GROUP BY batch""")
def wsp05_run_rollup(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem")
    out = F.when(F.col("l_returnflag") == "A", "missing").when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "no contract").otherwise("ran")
    code = F.when(F.col("l_returnflag") == "R", F.rint("l_quantity").cast("int") % 3).otherwise(0)  # the SQL's cast rounds, halves to even
    place = F.struct("_metadata.file_path", "_metadata.row_index")  # line items of equal number and part: the first in the table, as in the SQL
    return fleet.run_rollup(li.select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("position"), out.alias("outcome"), code.alias("code"), place.alias("place")))


@query(f"SELECT role, coalesce(license, 'unknown') AS license, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 > 0) AS n_locked, CAST(count(DISTINCT p_type) + count(DISTINCT p_brand) AS INTEGER) AS n_capabilities FROM ({REPOS}) GROUP BY 1, 2")
def wsp06_inventory_report(spark, sf_dir):
    return fleet.inventory_report(_repos(spark, sf_dir), _lock(spark, sf_dir, 3))


@query(f"SELECT name, role, CASE WHEN p_partkey % 3 > 0 THEN 'r' || CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 0 END END AS rev, coalesce(license, 'unknown') AS license, least(p_type, p_brand) || ',' || greatest(p_type, p_brand) AS capabilities FROM ({REPOS})")
def wsp06_inventory_rows(spark, sf_dir):
    return fleet.inventory_rows(_repos(spark, sf_dir), _lock(spark, sf_dir, 3)).withColumn("capabilities", F.array_join("capabilities", ","))


@query("SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a,b' END AS missing FROM part WHERE p_partkey % 4 <> 0")
def wsp07_capability_match(spark, sf_dir):
    r = _repos(spark, sf_dir)
    have = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("z")))
    return fleet.capability_match(r.select("name", F.array(F.lit("b"), F.lit("a")).alias("required_capabilities")), r.where("p_partkey % 2 = 0").select("name", have.alias("capabilities")))


@query(f"SELECT a.name AS src, b.name AS dst FROM ({REPOS}) a JOIN ({REPOS}) b ON b.p_partkey = a.p_partkey + 1 WHERE NOT (a.role = 'component' AND b.role = 'adapter') AND NOT (a.role = 'adapter' AND b.role = 'third_party')")
def wsp08_dependency_violations(spark, sf_dir):
    r = _repos(spark, sf_dir)
    e = r.select(F.col("name").alias("src"), F.col("role").alias("src_role"), (F.col("p_partkey") + 1).alias("k")).join(r.select(F.col("name").alias("dst"), F.col("role").alias("dst_role"), F.col("p_partkey").alias("k")), "k")
    ok = spark.createDataFrame([("component", "adapter"), ("adapter", "third_party")], "src_role string, dst_role string")
    return fleet.dependency_violations(e, ok).select("src", "dst")


@query("WITH n AS (SELECT p_brand AS name, max((p_size % 3) * 1000000 + (p_size % 12) * 10000 + p_partkey) AS m FROM part GROUP BY 1), d AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, m >= 2 * 1000000 + 10 * 10000 + 1 AS ok FROM d JOIN n USING (name)")
def wsp09_semver_satisfies(spark, sf_dir):
    p = v.table(spark, sf_dir, "part")
    versions = p.select(F.col("p_brand").alias("name"), F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 12).cast("string"), F.col("p_partkey").cast("string")).alias("version"))
    return fleet.semver_satisfies(p.select(F.col("p_brand").alias("name")).distinct().withColumn("needs", F.lit(">=2.10.1")), versions).select("name", "ok")


@query("SELECT term, count(DISTINCT doc_id) AS n FROM documents JOIN (VALUES ('License'), ('token'), ('the')) t(term) ON contains(text, term) GROUP BY term")
def wsp10_reference_counts(spark, sf_dir):
    return fleet.reference_counts(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), ["License", "token", "the", "no such term"])


@query("SELECT role AS kind, ext AS extension, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes, count(*) FILTER (WHERE b = 0) AS n_empty FROM (SELECT p_brand AS role, CASE WHEN p_partkey % 3 = 0 THEN 'md' WHEN p_partkey % 3 = 1 THEN 'py' ELSE '' END AS ext, p_size % 7 AS b FROM part) GROUP BY 1, 2")
def wsp11_file_inventory(spark, sf_dir):
    ext = F.when(F.col("p_partkey") % 3 == 0, ".MD").when(F.col("p_partkey") % 3 == 1, ".py").otherwise("")
    return fleet.file_inventory(v.table(spark, sf_dir, "part").select(F.concat(F.lit("a.b/"), F.col("p_partkey"), ext).alias("path"), F.col("p_brand").alias("kind"), (F.col("p_size") % 7).cast("long").alias("bytes")))


@query(f"SELECT name, CASE WHEN license IS NULL THEN 'no hint' ELSE 'not allowed' END AS outcome FROM ({REPOS}) WHERE license IS NULL OR license NOT IN ('Brand#11', 'Brand#12')")
def wsp12_license_gate(spark, sf_dir):
    return fleet.license_gate(_repos(spark, sf_dir), ["Brand#11", "Brand#12"])


@query(f"SELECT name FROM ({REPOS}) WHERE role <> 'docs' AND p_partkey % 6 = 0")
def wsp13_role_path_check(spark, sf_dir):
    return fleet.role_path_check(_repos(spark, sf_dir)).select("name")


@query("SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'not locked' ELSE 'not in manifest' END AS problem FROM part WHERE (p_partkey % 3 = 0) <> (p_partkey % 5 = 0)")
def wsp14_lock_verify(spark, sf_dir):
    return fleet.lock_verify(_repos(spark, sf_dir).where("p_partkey % 5 > 0"), _lock(spark, sf_dir, 3))


STEPS = "CASE event_type WHEN 'signup' THEN 'a2a.author.propose' WHEN 'purchase' THEN 'a2a.done' ELSE event_type END"


def _carriers(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    return e.select(F.expr(STEPS).alias("type"), v.stamp("ts").alias("time"), F.col("props").alias("payload"), (F.col("user_id") % 2 == 0).alias("dryRun"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))


@query("SELECT count(*) FILTER (WHERE event_id % 10 > 0) AS verified, count(*) FILTER (WHERE event_id % 10 = 0) AS failed FROM events")
def car01_carrier_integrity(spark, sf_dir):
    c = _carriers(spark, sf_dir)
    c = c.withColumn("digest", F.when(F.col("event_id") % 20 == 0, "0").otherwise(fleet.carrier_digest())).withColumn("payload", F.when(F.col("event_id") % 20 != 10, F.col("payload")))
    return fleet.carrier_integrity(c)


@query(f"""WITH c AS (SELECT user_id, {STEPS} AS type, date_trunc('second', ts) AS tm, ts, event_id FROM events), s AS (SELECT *, sum(CASE WHEN type = 'a2a.author.propose' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM c)
  SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_steps, count(DISTINCT type) AS n_types, CAST(date_diff('second', min(tm), min(CASE WHEN type = 'a2a.done' THEN tm END)) AS DOUBLE) AS seconds FROM s GROUP BY user_id, session""")
def car02_lifecycle_sessions(spark, sf_dir):
    c = _carriers(spark, sf_dir).select("user_id", "type", F.col("at").alias("time"), F.col("event_id").alias("id"))
    return fleet.lifecycle_sessions(c, "user_id").select("user_id", "session", "n_steps", "n_types", F.col("seconds").cast("double").alias("seconds"))


@query(f"SELECT {STEPS} AS type, count(*) FILTER (WHERE user_id % 2 = 0) AS dry, count(*) FILTER (WHERE user_id % 2 = 1) AS live FROM events GROUP BY 1")
def car03_dryrun_rollup(spark, sf_dir):
    return fleet.dryrun_rollup(_carriers(spark, sf_dir))


@query("SELECT o_custkey AS epoch, count(DISTINCT o_orderstatus) AS n_sites FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 2 = 1 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def ham01_split_brain(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("epoch"), F.col("o_orderstatus").alias("site"))
    return fleet.split_brain(o, o.where("epoch % 2 = 0"))


ROLES = "SELECT user_id AS site, ts, CASE WHEN event_id % 3 = 0 THEN 'passive' ELSE 'active' END AS role FROM events WHERE event_type = 'view'"


@query(f"""WITH r AS ({ROLES}), a AS (SELECT user_id AS site, ts, event_id FROM events WHERE event_type = 'click') SELECT site, event_id AS id FROM (SELECT a.site, a.event_id, arg_max(r.role, r.ts) AS role FROM a JOIN r ON a.site = r.site AND r.ts <= a.ts GROUP BY a.site, a.event_id) WHERE role = 'passive'""")
def ham02_passive_violations(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    acts = e.where("event_type = 'click'").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.lit("train").alias("action"), F.col("event_id").alias("id"))
    return fleet.passive_violations(acts, _roles(e)).select("site", "id")


def _roles(e):
    return e.where("event_type = 'view'").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "passive").otherwise("active").alias("role"))


@query(f"SELECT site, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, prev AS from_role, role FROM (SELECT *, lag(role) OVER (PARTITION BY site ORDER BY ts) AS prev FROM ({ROLES})) WHERE prev <> role")
def ham03_failovers(spark, sf_dir):
    return fleet.failovers(_roles(v.table(spark, sf_dir, "events"))).withColumn("at", v.stamp("at"))

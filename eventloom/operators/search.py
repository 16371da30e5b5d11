"""Search, ranking, governance and graph exploration (SEA-01 to SEA-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parts import parts_for
from ..functions.scratch import cut
from ..functions.vectors import block_topk
from . import components
from .lexical import lexical_search  # noqa: F401

#: Boost of a result's kind in a search mode; fixed values of the search contract. Any other pair has none.
BOOSTS = {
    "blended": {"local_file": 0.05, "entity": 0.05, "web_doc": 0.03, "collection": 0.04},
    "local": {"local_file": 0.12, "entity": 0.02, "web_doc": -0.10, "collection": -0.05},
    "global": {"local_file": -0.08, "entity": 0.06, "web_doc": 0.10, "collection": 0.08},
}


def score_parts(docs: DataFrame, q: str, mode: str = "blended", boosts: dict[str, dict[str, float]] = BOOSTS) -> DataFrame:
    """SEA-09. docs(id, kind, title, snippet, score) with why: base, match and boost beside the score."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("snippet", F.lit(""))))
    base = F.coalesce("score", F.lit(0.5))
    match = F.when(F.contains(text, F.lit(q.lower())), 0.20).otherwise(0.0)
    boost = F.lit(0.0)
    for kind, x in boosts.get(mode, {}).items():
        boost = F.when(F.col("kind") == kind, x).otherwise(boost)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + match + boost))
    return docs.withColumn("why", F.struct(base.alias("base"), match.alias("match"), boost.alias("boost"))).withColumn("score", total)


def search(docs: DataFrame, q: str, mode: str = "blended", position: str = "id", boosts: dict[str, dict[str, float]] = BOOSTS) -> DataFrame:
    """SEA-01. Every document with its score and rank; nothing is left out. Ties keep the order of position."""
    out = score_parts(docs, q, mode, boosts).drop("why")
    return out.orderBy(F.desc("score"), position)


def vector_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """SEA-03. Top k of docs(id, embedding) for queries(query_id, q) by cosine, ties by id."""
    return block_topk(docs, queries, k)


def hybrid_search(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """SEA-04. Reciprocal rank fusion of rankings (query_id, id, rank): sum of 1 / (constant + rank) to 12 places, ties by id."""
    rows = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    s = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def facets(results: DataFrame, cols: list[str]) -> DataFrame:
    """SEA-05. (facet, value, n): counts by each column, in one pass of grouping sets."""
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])
    return results.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def paginate(results: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """SEA-06. Page of a ranked result, from 1."""
    return results.orderBy(*order).offset((page - 1) * size).limit(size)


def apply_filters(docs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """SEA-07. Rows whose columns equal the given values."""
    for c, v in filters.items():
        docs = docs.where(F.col(c) == v)
    return docs


def annotate_trust(results: DataFrame, registry: DataFrame) -> DataFrame:
    """SEA-08. results(source, ...) with trust of registry(source, trust); mixed by default."""
    return results.join(registry, "source", "left").withColumn("trust", F.coalesce("trust", F.lit("mixed")))


def recent_queries(log: DataFrame, n: int = 20) -> DataFrame:
    """SEA-10. Of (user, q, ts): each user's last n distinct trimmed, non-empty queries, newest first."""
    q = log.withColumn("q", F.trim("q")).where("q <> ''").groupBy("user", "q").agg(F.max("ts").alias("ts"))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), "q"))).where(F.col("rank") <= n)


def entity_route(results: DataFrame) -> DataFrame:
    """SEA-11. results(id, kind) with route: the page type of the kind, and the id encoded for a URL."""
    page = F.when(F.col("kind") == "entity", "company").when(F.col("kind") == "local_file", "file").otherwise("doc")
    shown = F.url_encode(F.col("id").cast("string"))
    for code, c in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        shown = F.replace(shown, F.lit(code), F.lit(c))
    return results.withColumn("route", F.concat(F.lit("/entity/"), page, F.lit("/"), shown))


def membrane_guard(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """SEA-12. requests(request_id, action, claims) against policies(action, effect, required): allow with a matching allow policy whose claims are all held, else deny."""
    met = requests.join(policies, "action", "left")
    ok = (F.col("effect") == "allow") & (F.size(F.array_except("required", "claims")) == 0)
    return met.groupBy("request_id").agg(F.when(F.bool_or(F.coalesce(ok, F.lit(False))), "allow").otherwise("deny").alias("decision"))


def audit_coverage(operations: DataFrame, audit: DataFrame) -> DataFrame:
    """SEA-13. State-changing operations(trace_id, mutates, ...) with no audit event on their trace."""
    return operations.where("mutates").join(audit, "trace_id", "left_anti")


def governance_rollup(decisions: DataFrame) -> DataFrame:
    """SEA-14. Of (principal, roles, outcome, at): decisions by principal, role, outcome and day."""
    return decisions.select("principal", F.explode("roles").alias("role"), "outcome", F.to_date("at").alias("day")).groupBy("principal", "role", "outcome", "day").agg(F.count("*").alias("n"))


def ingest_documents(batch: DataFrame, store: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """SEA-15. The store (id, text, version, hash), where an id stands once, after a batch (id, text, version): newest wins, of
    equal versions the first in text order; content that is the same is left as it was. within: columns of both that an id fixes."""
    cols = ["id", "text", "version", "hash", *within]
    new = batch if "hash" in batch.columns else batch.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    new = new.select(*cols, F.lit(False).alias("stored"))
    rows = store.select(*cols, F.lit(True).alias("stored")).unionByName(new).repartition(*(within or ("id",)))
    w = Window.partitionBy(*within, "id").orderBy(F.desc("stored"), F.desc("version"), "text")
    state = F.struct("stored", "version", "hash")
    rows = rows.withColumns({"r": F.row_number().over(w), "o": F.lag(state).over(w), "n": F.lead(state).over(w)})
    beats = lambda n, o: F.coalesce((n("version") > o("version")) & (n("hash") != o("hash")), F.lit(False))
    at = lambda c: lambda name: F.col(c)[name]
    action = F.when(F.col("stored"), F.when(~beats(at("n"), F.col), "keep")).when(F.col("r") == 1, "insert").when((F.col("r") == 2) & F.col("o.stored") & beats(F.col, at("o")), "update")
    return rows.withColumn("action", action).where("action IS NOT NULL").select(*cols, "action")


def ingest_into(batch: DataFrame, path: str, parts: int = 64) -> DataFrame:
    """SEA-15. Puts a batch (id, text, version) into the store (id, text, version, hash) at path, which is laid out in parts by
    the hash of the id. Only parts that the batch touches are read, and only those in which a document changes are written
    again. Returns (id, action) of the batch's documents. A batch that runs again changes nothing.

    What changes is told by versions and hashes; texts are read, dealt and written once, and only those of parts that change.
    """
    spark = batch.sparkSession
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    batch = cut(batch.select("id", "text", "version", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), part("id").alias("part")))
    touched = [r["part"] for r in batch.select("part").distinct().collect()]  # parts numbers at most
    shape = f"id {batch.schema['id'].dataType.simpleString()}, text string, version {batch.schema['version'].dataType.simpleString()}, hash string, part int"
    read = lambda: spark.read.schema(shape).parquet(path) if there else spark.createDataFrame([], shape)
    state = lambda name: read().where(F.col("part").isin(touched)).select("id", F.struct("version", "hash").alias(name))
    before = cut(state("o"))
    newest = batch.select("id", "version", "hash", "part", F.rank().over(Window.partitionBy("id").orderBy(F.desc("version"))).alias("r")).where("r = 1")
    differs = F.col("o").isNull() | ((F.col("version") > F.col("o.version")) & (F.col("hash") != F.col("o.hash")))
    changed = [r["part"] for r in newest.join(before, "id", "left").where(differs).select("part").distinct().collect()]
    if changed:
        some = lambda df: df.where(F.col("part").isin(changed))
        rows = ingest_documents(some(batch), some(read()), ("part",)).drop("action")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        there = True
    met = batch.select("id").where("id IS NOT NULL").distinct().join(before, "id", "left").join(state("n"), "id", "left")
    return cut(met.select("id", F.when(F.col("o").isNull(), "insert").when(F.col("o").eqNullSafe(F.col("n")), "keep").otherwise("update").alias("action")))


TILE = 256  # entities of a document that meet as many others in one task
PART = 1 << 18  # mentions of small documents in one task


def co_mentions(mentions: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of each pair of a document's distinct entities, src before dst, of mentions(doc_id, entity).

    Documents of up to TILE mentions are dealt to tasks by the count of rows, and each makes its pairs from one short array.
    Of larger ones, entities are dealt to tiles of about TILE, and each pair of tiles is a join key of its own, so that the
    largest document gives many keys of one size.
    """
    m = mentions.select("doc_id", "entity").where("doc_id IS NOT NULL AND entity IS NOT NULL")
    large = cut(m.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("doc_id"))
    if large.isEmpty():
        return _short(m)
    return _short(m.join(large, "doc_id", "left_anti")).unionByName(_tiled(m.join(large, "doc_id", "left_semi")))


def _short(m: DataFrame) -> DataFrame:
    """co_mentions of documents with few mentions each."""
    sets = m.repartition(parts_for(m, PART), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))  # TILE at most
    first = sets.where("size(e) > 1").select("doc_id", "e", F.posexplode("e").alias("i", "src"))
    return first.select("doc_id", "src", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("dst"))


def _tiled(m: DataFrame) -> DataFrame:
    """co_mentions of documents with any number of mentions."""
    m = m.distinct()
    n = m.groupBy("doc_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    m = m.join(n, "doc_id").withColumn("tile", F.pmod(F.xxhash64("entity"), F.col("tiles")).cast("int"))
    left = m.select("doc_id", F.col("tile").alias("a"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("b"), F.col("entity").alias("x"))
    right = m.select("doc_id", F.explode(F.sequence(F.lit(0), "tile")).alias("a"), F.col("tile").alias("b"), F.col("entity").alias("y"))
    met = left.join(right, ["doc_id", "a", "b"]).where("a < b OR x < y")
    return met.select("doc_id", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def semantic_graph(mentions: DataFrame) -> DataFrame:
    """SEA-16. (src, dst, weight): how many documents mention both entities, of mentions(doc_id, entity). Each task adds up its pairs before weights are shuffled."""
    return co_mentions(mentions).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def graph_ranking(edges: DataFrame, queries: DataFrame, hops: int, k: int) -> DataFrame:
    """(query_id, id, rank) of the nodes within some hops of queries(query_id), nearest first, ties by id, themselves left out: the graph's part in SEA-04."""
    near = components.k_hop(edges, queries.select(F.col("query_id").alias("seed")), hops).where("distance > 0")
    r = near.select(F.col("seed").alias("query_id"), F.col("node").alias("id"), F.row_number().over(Window.partitionBy("seed").orderBy("distance", "node")).alias("rank"))
    return r.where(F.col("rank") <= k)


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """SEA-17. (seed, node, distance) within k hops."""
    return components.k_hop(edges, seeds, k)


def envelope_check(requests: DataFrame) -> DataFrame:
    """SEA-18. Requests that lack trace_id, principal, locale or schema_ref, and what they lack."""
    names = ["trace_id", "principal", "locale", "schema_ref"]
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return requests.withColumn("missing", F.array_join(lacks, ",")).where("missing <> ''")


def provenance_panel(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """SEA-19. results(id, ...) with the evidence(id, source, quote, snapshot) gathered for each, sorted: what one page shows. provenance_rows has it as rows, for results with more than one row should hold."""
    e = evidence.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("source", "quote", "snapshot"))).alias("evidence"))
    return results.join(e, "id", "left")


def provenance_rows(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """SEA-19 by rows: results(id, ...) with one row for each of their evidence, or one with nulls."""
    return results.join(evidence.select("id", "source", "quote", "snapshot"), "id", "left")

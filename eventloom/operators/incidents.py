"""Incident pipelines (GRP, LOC, STO, ANO, SIM). The outputs are the topics' records; the methods are choices, stated in each text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import once
from ..functions.medians import group_medians
from ..functions.parts import parts_for
from ..functions.scans import Scan
from ..functions.scratch import cut
from ..functions.vectors import block_topk, hashed_topk
from . import components
from .normalize import severity_rank


PART = 25_000  # mentions whose pairs one task makes
HOT = 4096  # mentions of an entity in one bucket that one piece holds; of those whose gap reaches it, 8 times as many


def correlate_pairs(mentions: DataFrame, max_gap_s: int) -> DataFrame:
    """GRP-01. (a, b, kind, id) of records of (record_id, kind, id, at) that share an entity within max_gap_s seconds.

    Times are cut in buckets of a quarter of the gap, and a row meets the buckets that its gap reaches, so the join is an equi
    join. Pairs are many more than rows: (entity, bucket) are dealt to tasks by the count of rows, none of them sent to all.
    Where a bucket has more than HOT mentions, both sides are dealt to pieces, and each pair of pieces is a key of its own.
    """
    gap = max_gap_s * 1_000_000
    width = max(1, gap // 4)
    key = ["kind", "id", "bucket"]
    m = mentions.select("record_id", "kind", "id", F.unix_micros("at").alias("t"))
    left = m.select(F.col("record_id").alias("a"), "kind", "id", F.col("t").alias("ta"), F.explode(F.expr(f"sequence(t div {width}, (t + {gap}) div {width})")).alias("bucket"))
    right = m.select(F.col("record_id").alias("b"), "kind", "id", F.col("t").alias("tb"), F.expr(f"t div {width}").alias("bucket"))
    hot = cut(right.groupBy(*key).agg(F.count("*").alias("n")).where(f"n > {HOT}"))
    if not hot.isEmpty():
        reached = hot.select("kind", "id", F.explode(F.expr(f"sequence(bucket, bucket + {gap // width + 1})")).alias("bucket"), F.col("n").alias("n_left"), F.lit(0).alias("n"))
        both = reached.unionByName(hot.withColumn("n_left", F.lit(0))).groupBy(*key).agg(F.ceil((F.sum("n_left") + 1) / (8 * HOT)).cast("int").alias("pl"), F.ceil((F.sum("n") + 1) / HOT).cast("int").alias("pr"))
        both = cut(both)
        piece = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
        left = left.join(both, key, "left").select("a", "ta", *key, piece("a", "pl").alias("i"), every("pr").alias("j"))
        right = right.join(both, key, "left").select("b", "tb", *key, piece("b", "pr").alias("j"), every("pl").alias("i"))
        key = [*key, "i", "j"]
    met = left.repartition(parts_for(m, PART), *key).join(right.hint("merge"), key).where((F.col("tb") - F.col("ta")).between(0, gap) & ((F.col("tb") > F.col("ta")) | (F.col("a") < F.col("b"))))
    return met.select("a", "b", "kind", "id")


def _ordered(mentions: DataFrame) -> Scan:
    return Scan(mentions, ["kind", "id"], ["at", "record_id"])


def group_by_gap(mentions: DataFrame, gap_s: int) -> DataFrame:
    """GRP-02. mentions with group_no within their entity: a new group when more than gap_s seconds pass. An entity with most of the rows is scanned in even parts."""
    last = _ordered(mentions).values(lags={"_before": F.col("at")})
    new = (F.unix_micros("at") - F.unix_micros("_before") > gap_s * 1_000_000).cast("long")
    return last.values(sums={"group_no": new}).result().drop("_before")


def consecutive_pairs(mentions: DataFrame, max_gap_s: int) -> DataFrame:
    """(a, b, kind, id) of records that follow each other within an entity in max_gap_s seconds: the same components as all pairs of correlate_pairs, in linear size."""
    m = _ordered(mentions).values(lags={"_before": F.struct("record_id", "at")}).result()
    return m.where(F.unix_micros("at") - F.unix_micros("_before.at") <= max_gap_s * 1_000_000).select(F.col("_before.record_id").alias("a"), F.col("record_id").alias("b"), "kind", "id")


def count_pairs(groups: DataFrame, max_gap_s: int) -> DataFrame:
    """(group_id, n_pairs) of groups(group_id, kind, id, record_id, at): how many pairs correlate_pairs would give within each
    group, counted without making them. Each record also stands at its time plus the gap; what the entity's running count
    has gathered by then, less the record's own place, is the number of records it pairs with."""
    here = groups.select("group_id", "kind", "id", "record_id", F.unix_micros("at").alias("t"), F.lit(0).alias("probe"))
    both = here.unionByName(here.withColumns({"t": F.col("t") + max_gap_s * 1_000_000, "probe": F.lit(1)}))
    seen = Scan(both, ["kind", "id"], ["t", "probe", "record_id"]).values(sums={"seen": 1 - F.col("probe")}).result()
    return seen.groupBy("group_id").agg(F.sum(F.when(F.col("probe") == 1, F.col("seen")).otherwise(-F.col("seen"))).alias("n_pairs"))


def group_components(pairs: DataFrame) -> DataFrame:
    """GRP-03. (node, component): pairs merged transitively."""
    return components.connected(pairs)


def emit_event_groups(groups: DataFrame, n_pairs: DataFrame | None = None) -> DataFrame:
    """GRP-04. event.groups.v1 of (group_id, record_id, at): score is the share of possible pairs that were found, by n_pairs(group_id, n_pairs); 1 for a single member or without n_pairs.

    The record holds all its members by contract; group_members has them as rows, for groups that one row should not hold.
    """
    g = groups.groupBy("group_id").agg(F.max("at").alias("created_at"), F.sort_array(F.collect_set("record_id")).alias("member_refs"))
    n = F.size("member_refs")
    if n_pairs is None:
        score = F.lit(1.0)
    else:
        g = g.join(n_pairs, "group_id", "left")
        score = F.when(n == 1, 1.0).otherwise(F.coalesce(F.col("n_pairs"), F.lit(0)) / (n.cast("double") * (n - 1) / 2))
    return g.select("group_id", "created_at", "member_refs", score.alias("score"), F.concat(n.cast("string"), F.lit(" records")).alias("reason"), F.lit(None).cast("string").alias("attributes"))


def group_members(groups: DataFrame) -> DataFrame:
    """GRP-04 by rows: (group_id, member_ref), each once."""
    return groups.select("group_id", F.col("record_id").alias("member_ref")).distinct()


def topology_neighbors(edges: DataFrame) -> DataFrame:
    """LOC-01. (node, neighbors): both directions, sorted."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("n")))
    return both.groupBy("node").agg(F.sort_array(F.collect_set("n")).alias("neighbors"))


def topology_path(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """LOC-02. (start, node, path) from each root of roots(start)."""
    return components.shortest_paths(edges, roots, max_depth)


def entity_of(kind: Column, id: Column, name: Column | None = None, labels: Column | None = None) -> Column:
    """An entity of the contracts: kind, id, name, labels."""
    return F.struct(kind.alias("kind"), id.cast("string").alias("id"), (name if name is not None else F.lit(None)).cast("string").alias("name"), (labels if labels is not None else F.lit(None)).cast("map<string,string>").alias("labels"))


def localize(members: DataFrame, paths: DataFrame, near: DataFrame, at: str) -> DataFrame:
    """LOC-03. event.localized.v1 of members(ref_id, kind, id): primary is the most frequent entity of each group (ties by
    kind, id), confidence its share, with its path from the root and its neighbours; attributes count the group's entities.

    The nodes of paths(node, path) and near(node, neighbors) are ids of entities of kind service; an entity that the
    topology lacks is its own path.
    """
    n = members.groupBy("ref_id", "kind", "id").agg(F.count("*").alias("n"))
    best = n.groupBy("ref_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_entities"), F.min(F.struct((-F.col("n")).alias("least"), "kind", "id")).alias("b"))
    met = best.withColumn("node", F.col("b.id")).join(paths.select("node", "path"), "node", "left").join(near.select("node", "neighbors"), "node", "left")
    nodes = lambda c: F.transform(c, lambda x: entity_of(F.lit("service"), x))
    primary = entity_of(F.col("b.kind"), F.col("b.id"))
    location = F.struct(primary.alias("primary"), F.coalesce(nodes(F.col("path")), F.array(primary)).alias("path"), F.coalesce(nodes(F.col("neighbors")), F.filter(F.array(primary), lambda x: F.lit(False))).alias("neighbors"))
    return met.select(F.col("ref_id").cast("string").alias("ref_id"), F.lit(at).cast("timestamp").alias("localized_at"), location.alias("location"), (-F.col("b.least") / F.col("total")).alias("confidence"), F.to_json(F.struct(F.col("total").alias("mentions"), F.col("n_entities").alias("entities"))).alias("attributes"))


def derive_stories(members: DataFrame) -> DataFrame:
    """STO-01. derived.stories.v1 of (group_id, record_id, at, severity, source, kind, id): title and severity by the worst
    member, all records and entities of each group, a summary of how many and since when, the first source as a label.

    The record holds its evidence by contract; incidents.group_members has a group's records as rows.
    """
    worst = F.max(F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))["severity"]
    entities = F.sort_array(F.collect_set(F.struct("kind", F.col("id").cast("string").alias("id"))))
    g = members.groupBy("group_id").agg(F.max("at").alias("created_at"), F.min("at").alias("first_at"), worst.alias("severity"), F.sort_array(F.collect_set("record_id")).alias("evidence_refs"), entities.alias("e"), F.min("source").alias("source"), F.count_distinct("source").alias("n_sources"))
    n = F.size("evidence_refs")
    summary = F.concat(n.cast("string"), F.lit(" records of "), F.size("e").cast("string"), F.lit(" entities since "), F.date_format("first_at", "yyyy-MM-dd HH:mm:ss"))
    return g.select(
        F.concat(F.lit("story-"), F.col("group_id")).alias("story_id"), "created_at", F.concat(F.col("severity"), F.lit(" in "), F.col("source")).alias("title"), summary.alias("summary"), "severity", "evidence_refs",
        F.transform("e", lambda x: entity_of(x["kind"], x["id"])).alias("entities"), F.create_map(F.lit("source"), F.col("source")).alias("labels"), F.to_json(F.struct(n.alias("records"), F.col("n_sources").alias("sources"))).alias("attributes"),
    )


def rate_anomalies(logs: DataFrame, width: str, lookback: int, z: float) -> DataFrame:
    """ANO-01. Of (source, at): buckets whose count lies z deviations from the mean of the lookback buckets before (two of them at least)."""
    n = logs.groupBy("source", F.window("at", width).alias("w")).agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("bucket"), "n")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(-lookback, -1)
    out = n.withColumns({"mean": F.avg("n").over(w), "sd": F.stddev_samp("n").over(w)})
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd"))).where(F.abs("z") >= z)


def value_anomalies(logs: DataFrame, z: float) -> DataFrame:
    """ANO-02. Of (id, source, value): robust z (0.6745 deviations over the median absolute deviation) at or beyond z."""
    m = logs.join(cut(group_medians(logs, ["source"], "value", "med")), "source").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    out = m.join(group_medians(m, ["source"], "dev", "mad"), "source").withColumn("z", F.when(F.col("mad") > 0, 0.6745 * (F.col("value") - F.col("med")) / F.col("mad")))
    return out.where(F.abs("z") >= z).select("id", "source", "value", "z")


def template_of(message: Column) -> Column:
    """Message with quoted text, hexadecimal runs and numbers masked."""
    t = F.regexp_replace(message, r"\"[^\"]*\"|'[^']*'", "<str>")
    t = F.regexp_replace(t, r"\b(0x)?[0-9a-fA-F]{8,}\b", "<hex>")
    return F.regexp_replace(t, r"[0-9]+(\.[0-9]+)?", "<num>")


def log_templates(logs: DataFrame, rare: int) -> DataFrame:
    """ANO-03. (source, template, n, rare) of (source, message)."""
    return logs.groupBy("source", template_of(F.col("message")).alias("template")).agg(F.count("*").alias("n")).withColumn("rare", F.col("n") <= rare)


def novel_templates(logs: DataFrame, baseline: DataFrame) -> DataFrame:
    """ANO-04. Templates of logs that the baseline lacks, with their counts."""
    t = logs.groupBy(template_of(F.col("message")).alias("template")).agg(F.count("*").alias("n"))
    return t.join(baseline.select(template_of(F.col("message")).alias("template")), "template", "left_anti")


def emit_log_anomalies(found: DataFrame, detector: str) -> DataFrame:
    """ANO-05. log.anomalies.v1 of (anomaly_id, at, z, ref_ids): score is 1 - 1 / (1 + |z|)."""
    z = F.abs("z")
    return found.select("anomaly_id", F.col("at").alias("detected_at"), F.lit(detector).alias("detector"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 1 / (1 + z))).alias("score"), "ref_ids", F.concat(F.lit("z "), F.format_string("%.2f", F.col("z"))).alias("explanation"), F.to_json(F.struct(F.round("z", 6).alias("z"))).alias("features"), F.lit(None).cast("string").alias("attributes"))


def embed_text(df: DataFrame, col: str, dim: int = 256) -> DataFrame:
    """SIM-01. df with embedding: hashed TF-IDF of column col as a unit vector (zero for no words), and model.

    A word's place is the first 32 bits of its MD5, modulo dim; the weight of a place is ln((rows + 1) / (rows with it + 1)).
    Rows stay where they are; what is gathered is one number a place.
    """
    word = F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\W+"), lambda x: x != "")
    place = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    hashed = df.withColumn("_b", once(F.sort_array(F.transform(word, place))))
    known = hashed.select(F.explode(F.array_distinct("_b")).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    n, rows = {r["b"]: r["n"] for r in known}, df.count()
    weight = F.lit([math.log((rows + 1) / (n.get(i, 0) + 1)) for i in range(dim)])
    # of the sorted places, the distinct ones and where each begins; then how often each stands there
    hashed = hashed.withColumn("_d", once(F.array_distinct("_b"))).withColumn("_p", once(F.transform("_d", lambda x: F.array_position("_b", x))))
    tf = F.zip_with("_p", F.concat(F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))), F.array(F.size("_b").cast("long") + 1)), lambda p, q: q - p)
    hashed = hashed.withColumn("_x", once(F.when(F.size("_d") > 0, F.zip_with("_d", tf, lambda i, c: c * F.get(weight, i))).otherwise(F.array().cast("array<double>"))))
    size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x))
    hashed = hashed.withColumn("_s", size)
    at = lambda i: F.coalesce(F.get("_x", F.array_position("_d", i.cast("int")).cast("int") - 1) / F.col("_s"), F.lit(0.0))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("_s") > 0, at(i)).otherwise(0.0))
    return hashed.withColumn("embedding", dense).withColumn("model", F.lit(f"hashed-tfidf-{dim}")).drop("_b", "_d", "_p", "_x", "_s")


def similar_topk(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """SIM-02. Exact top k of df(id, embedding) for each of a stated set of queries(id, embedding), by cosine (0 at least); self left out, ties by id."""
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return block_topk(df, q, k, skip_self=True, floor=0.0).select(F.col("query_id").alias("ref_id"), "id", "score", "rank")


def similar_topk_approx(df: DataFrame, queries: DataFrame, k: int, max_distance: float, bucket: float = 1.0, tables: int = 6) -> DataFrame:
    """SIM-03. Approximate top k by locality-sensitive hashing of unit vectors: distance d means cosine 1 - d * d / 2, to 9 places.

    The hashes choose who is compared, within blocks: a join by them would make a row for each pair and each table, nearly
    all pairs where vectors have no near neighbours. Rows without a vector have no neighbours.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = lambda df: df.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", F.transform("embedding", lambda v: v.cast("double")).alias("x")).withColumn("v", array_to_vector("x"))
    d = x(df)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(d)
    hashed = lambda df: model.transform(df).select("id", "x", F.transform("h", lambda v: F.get(vector_to_array(v), F.lit(0)).cast("long")).alias("h"))
    met = hashed_topk(hashed(d), hashed(x(queries)).withColumnRenamed("id", "query_id"), k, max_distance)
    return met.withColumnRenamed("query_id", "ref_id")


def emit_similar_incidents(top: DataFrame, model: str, at: str) -> DataFrame:
    """SIM-04. similar.incidents.v1 of (ref_id, id, score, rank): k neighbours a record at most, by score, which is clamped to [0, 1]; features of a neighbour are its rank and unclamped score."""
    features = F.to_json(F.struct("rank", F.round("score", 6).alias("cosine")))
    n = F.struct(F.col("rank"), F.col("id").cast("string").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"), F.lit("cosine").alias("rationale"), features.alias("features"))
    g = top.groupBy("ref_id").agg(F.sort_array(F.collect_list(n)).alias("neighbors"))
    return g.select(F.col("ref_id").cast("string").alias("ref_id"), F.lit(at).cast("timestamp").alias("computed_at"), F.lit(model).alias("model"), F.transform("neighbors", lambda x: x.dropFields("rank")).alias("neighbors"), F.to_json(F.struct(F.size("neighbors").alias("k"))).alias("attributes"))

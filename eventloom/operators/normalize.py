"""Normalised records, severities and entities (NRM-01 to NRM-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scans import Scan


def _project(raw: DataFrame, topic: str, mapping: dict[str, Column]) -> DataFrame:
    from pyspark.sql.types import StructType

    return raw.select(*[mapping.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schemas.TOPICS[topic])])


def normalize_logs(raw: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """NRM-01. raw rows as normalized.logs.v1; mapping gives an expression for each field, others are null."""
    return _project(raw, "normalized.logs.v1", mapping)


def normalize_alerts(raw: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """NRM-02. raw rows as normalized.alerts.v1."""
    return _project(raw, "normalized.alerts.v1", mapping)


def entity(kind: str, id: Column, name: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), id.cast("string").alias("id"), (F.lit(None) if name is None else name).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("labels"))


def severity_rank(c: Column) -> Column:
    """NRM-03. debug 0 to critical 5; null if unknown."""
    at = F.array_position(F.array(*[F.lit(s) for s in schemas.SEVERITIES]), c)
    return F.when(at > 0, at - 1)


def severity_rollup(df: DataFrame, time_col: str, width: str) -> DataFrame:
    """NRM-04. Rows by source, severity and time bucket."""
    return df.groupBy("source", "severity", F.window(time_col, width).alias("w")).agg(F.count("*").alias("n")).select("source", "severity", F.col("w.start").alias("bucket"), "n")


def explode_entities(df: DataFrame, id_col: str, *keep: str) -> DataFrame:
    """NRM-05. One row for each record and entity; a record without entities has one row of nulls."""
    return df.select(F.col(id_col).alias("record_id"), *keep, F.explode_outer("entities").alias("e")).select("record_id", *keep, "e.kind", "e.id", "e.name", "e.labels")


def entity_profile(mentions: DataFrame, time_col: str) -> DataFrame:
    """NRM-06. Of (record_id, kind, id, source, severity, time): records, first and last seen, worst severity, sources of each entity."""
    worst = F.max(F.struct(severity_rank(F.col("severity")).alias("r"), "severity"))
    return mentions.where("id IS NOT NULL").groupBy("kind", "id").agg(F.count_distinct("record_id").alias("n_records"), F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen"), worst["severity"].alias("worst"), F.count_distinct("source").alias("n_sources"))


def entity_timeline(*tables: DataFrame) -> DataFrame:
    """NRM-07. Mentions (kind, id, topic, record_id, time) of several topics in time order, numbered within each entity; an entity with most of the rows is numbered in even parts."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return Scan(out, ["kind", "id"], ["time", "topic", "record_id"]).values(number="seq").result()


def filter_labels(df: DataFrame, selector: dict[str, str], own: str | None = None) -> DataFrame:
    """NRM-08. Records with an entity, or own label map, that bears all the key=value pairs."""

    def fits(m):
        hit = F.lit(True)
        for k, v in selector.items():
            hit = hit & F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
        return hit

    hit = F.coalesce(F.exists("entities", lambda e: fits(e["labels"])), F.lit(False))
    return df.where(hit | fits(F.col(own)) if own else hit)


def tag_counts(alerts: DataFrame) -> DataFrame:
    """NRM-09. Alerts of each tag; a tag that an alert repeats counts once."""
    return alerts.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def kind_report(mentions: DataFrame) -> DataFrame:
    """NRM-10. Distinct entities by kind, and whether the kind is a known one."""
    return mentions.where("kind IS NOT NULL").groupBy("kind").agg(F.count_distinct("id").alias("n"), F.first(F.col("kind").isin(*schemas.ENTITY_KINDS)).alias("known"))


def resolve_raw_ref(df: DataFrame, blobs: DataFrame) -> DataFrame:
    """NRM-11. df(raw_ref, ...) with the blob of blobs(ref, blob), and unresolved: a ref that has none."""
    met = df.join(blobs.select(F.col("ref").alias("raw_ref"), "blob"), "raw_ref", "left")
    return met.withColumn("unresolved", F.col("raw_ref").isNotNull() & F.col("blob").isNull())


def resolve_refs(artifact: DataFrame, id_col: str, refs_col: str, records: DataFrame) -> DataFrame:
    """NRM-12. (artifact_id, ref, dangling) of each reference against records(record_id)."""
    refs = artifact.select(F.col(id_col).alias("artifact_id"), F.explode(refs_col).alias("ref"))
    met = refs.join(records.select(F.col("record_id").alias("ref"), F.lit(True).alias("there")).distinct(), "ref", "left")
    return met.select("artifact_id", "ref", F.col("there").isNull().alias("dangling"))

"""Record schemas of the topics, as Spark DDL, and the small tables that describe them.

Open objects stay JSON strings. Fixed values of the event contracts: field names, enums, patterns, retention.
"""

from __future__ import annotations

ENTITY = "struct<kind:string,id:string,name:string,labels:map<string,string>>"

TOPICS = {
    "normalized.alerts.v1": f"alert_id string, observed_at timestamp, severity string, title string, description string, source string, raw_ref string, tags array<string>, entities array<{ENTITY}>, attributes string",
    "normalized.logs.v1": f"log_id string, observed_at timestamp, source string, message string, severity string, raw_ref string, entities array<{ENTITY}>, fields string",
    "derived.stories.v1": f"story_id string, created_at timestamp, title string, summary string, severity string, evidence_refs array<string>, entities array<{ENTITY}>, labels map<string,string>, attributes string",
    "event.groups.v1": "group_id string, created_at timestamp, member_refs array<string>, score double, reason string, attributes string",
    "event.localized.v1": f"ref_id string, localized_at timestamp, location struct<primary:{ENTITY},path:array<{ENTITY}>,neighbors:array<{ENTITY}>>, confidence double, attributes string",
    "similar.incidents.v1": "ref_id string, computed_at timestamp, model string, neighbors array<struct<id:string,score:double,rationale:string,features:string>>, attributes string",
    "log.anomalies.v1": "anomaly_id string, detected_at timestamp, detector string, score double, ref_ids array<string>, explanation string, features string, attributes string",
}
#: Key and event-time column of each topic.
KEYS = {
    "normalized.alerts.v1": ("alert_id", "observed_at"), "normalized.logs.v1": ("log_id", "observed_at"), "derived.stories.v1": ("story_id", "created_at"), "event.groups.v1": ("group_id", "created_at"),
    "event.localized.v1": ("ref_id", "localized_at"), "similar.incidents.v1": ("ref_id", "computed_at"), "log.anomalies.v1": ("anomaly_id", "detected_at"),
}
RETENTION_DAYS = {t: 7 if t.startswith("normalized") else 30 for t in TOPICS}
REQUIRED = {
    "normalized.alerts.v1": ["alert_id", "observed_at", "severity", "title", "source"], "normalized.logs.v1": ["log_id", "observed_at", "source", "message"],
    "derived.stories.v1": ["story_id", "created_at", "title", "evidence_refs"], "event.groups.v1": ["group_id", "created_at", "member_refs"], "event.localized.v1": ["ref_id", "localized_at", "location"],
    "similar.incidents.v1": ["ref_id", "computed_at", "neighbors"], "log.anomalies.v1": ["anomaly_id", "detected_at", "ref_ids", "score"],
}
SEVERITIES = ["debug", "info", "notice", "warning", "error", "critical"]
ENTITY_KINDS = ["host", "service", "cluster", "user", "ticket", "trace", "span", "custom"]
MIN_ITEMS = {"derived.stories.v1": ["evidence_refs"], "event.groups.v1": ["member_refs"], "similar.incidents.v1": ["neighbors"], "log.anomalies.v1": ["ref_ids"]}
UNIT_RANGES = {"event.groups.v1": ["score"], "event.localized.v1": ["confidence"], "log.anomalies.v1": ["score"]}
ENVELOPE = "specversion string, id string, source string, type string, time timestamp, datacontenttype string, dataschema string, subject string, traceparent string, tracestate string, extensions string, data string"
TYPE_PREFIX = "qes."


def columns(topic: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TOPICS[topic]).fieldNames()

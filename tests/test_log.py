import pytest
from pyspark.sql import functions as F

from eventloom.sources import log, topics
from eventloom.streaming import streams


@pytest.fixture
def events(spark):
    e = spark.range(1, 301).select(F.concat(F.lit("t/"), F.col("id") % 2).alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.timestamp_seconds(1000 - F.col("id")).alias("time"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("value"))
    return e.repartition(4)


def test_log_offsets_and_replay(spark, tmp_path, events, monkeypatch):
    monkeypatch.setattr(log, "ROWS", 7)
    path = str(tmp_path / "log")
    assert log.segments(path) == []
    log.append_log(events.where("key < 'k2'"), path)
    log.append_log(events.where("key >= 'k2'"), path)
    rows = log.read_log(spark, path).collect()
    assert len(rows) == 300 and {r["value"] for r in rows} == {str(i) for i in range(1, 301)}
    for t in ("t/0", "t/1"):
        for p in range(3):
            own = sorted((r["offset"], r["key"] >= "k2", r["time"]) for r in rows if (r["topic"], r["partition"]) == (t, p))
            assert [o for o, _, _ in own] == list(range(50)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    ranges = [("t/0", 1, 3, 20), ("t/0", 1, 15, 33), ("t/1", 2, 0, 5), ("t/1", 0, 48, 99), ("none", 0, 0, 9), ("t/0", 0, 5, 5)]
    want = {tuple(r) for r in rows if any((r["topic"], r["partition"]) == (t, p) and lo <= r["offset"] < hi for t, p, lo, hi in ranges)}
    got = log.replay_log(spark, path, ranges).collect()
    assert len(got) == len(want) == 37 and {tuple(r) for r in got} == want
    assert log.replay_log(spark, path, [("none", 1, 0, 3)]).count() == 0


def test_a_stream_resumes_at_its_offsets(spark, tmp_path, events):
    path, out, ck = (str(tmp_path / x) for x in ("log", "out", "ck"))
    for part in ("key < 'k15'", "key >= 'k15' AND key < 'k3'", "key >= 'k3'"):
        log.append_log(events.where(part), path)
        streams.start(log.read_log_stream(spark, path), out, ck)
        rows = spark.read.schema(log.SCHEMA).parquet(out).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, log.read_log(spark, path).collect()))
    streams.start(log.read_log_stream(spark, path), out, ck)  # nothing new
    assert spark.read.parquet(out).count() == 300


CATALOG = """version: 1
topics:
  - name: normalized.logs.v1
    kind: input
    retention: 3d
    schema: artifacts/normalized.logs.v1.json
  - kind: artifact   # the name comes later
    name: "event.groups.v1"
    retention: forever
"""


def test_topic_catalog_as_data(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CATALOG)
    c = topics.read_topic_catalog(spark, str(tmp_path / "c.yaml"))
    assert sorted(map(tuple, c.collect())) == [("event.groups.v1", "artifact", None, None), ("normalized.logs.v1", "input", 3, "artifacts/normalized.logs.v1.json")]
    days = spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).alias("observed_at"), F.timestamp_seconds(F.col("id") * 86400).alias("created_at"))
    assert topics.apply_retention(days, "normalized.logs.v1", "1970-01-10", c).count() == 4
    assert topics.apply_retention(days, "event.groups.v1", "1970-01-10", c).count() == 10
    assert topics.apply_retention(days, "normalized.logs.v1", "1970-01-10").count() == 8
    sent = spark.createDataFrame([("qes.event.groups.v1",), ("qes.derived.stories.v1",)], "type string")
    assert {r["type"]: r["topic"] for r in topics.route_topics(sent, c).collect()} == {"qes.event.groups.v1": "event.groups.v1", "qes.derived.stories.v1": "dead-letter"}


def test_registry_entries_with_a_later_id(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("metrics:\n  - kind: quality\n    id: b.f1\n    range: [0, 1]\n  - id: a\n    dimensions: [x]\n  - kind: none\n")
    assert [(r["id"], r["kind"], r["range"]) for r in topics.read_metric_registry(spark, str(tmp_path / "r.yaml")).collect()] == [("b.f1", "quality", [0.0, 1.0]), ("a", None, None)]

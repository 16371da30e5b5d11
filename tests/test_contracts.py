"""Rules and status-I semantics on small literal inputs, worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import adaptation, components, contenders, evaluate, fleet, incidents, normalize, search, validate
from eventloom.sources import topics


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_read_arrays_lines_and_empty_goldens(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"log_id": "l1", "observed_at": "2024-01-01T00:00:00Z", "source": "s", "message": "m", "entities": [{"kind": "host", "id": "h"}]}]))
    (tmp_path / "b.json").write_text("[]")
    got = topics.read_artifacts(spark, str(tmp_path / "a.json"), "normalized.logs.v1").collect()
    assert got[0]["log_id"] == "l1" and got[0]["entities"][0]["kind"] == "host"
    empty = topics.read_artifacts(spark, str(tmp_path / "b.json"), "event.groups.v1")
    assert empty.count() == 0 and empty.columns == schemas.columns("event.groups.v1")
    assert evaluate.assert_match_golden(empty, empty).first()["outcome"] == "passed"
    assert topics.read_raw(spark, str(tmp_path / "a.json")).count() == 1


@pytest.mark.parametrize("change, rule", [({"log_id": None}, "required"), ({"log_id": ""}, "minLength"), ({"severity": "odd"}, "enum"), ({"entities": [("host", None, None, None)]}, "required")])
def test_broken_logs(spark, change, rule):
    good = {"log_id": "l", "observed_at": None, "source": "s", "message": "m", "severity": "info", "raw_ref": None, "entities": [], "fields": None}
    df = spark.createDataFrame([{**good, **change}], schemas.TOPICS["normalized.logs.v1"]).withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    valid, held = validate.validate(df, "normalized.logs.v1")
    assert valid.count() == 0 and rule in [x["rule"] for x in held.first()["violations"]]


def test_broken_scores_and_refs(spark):
    df = spark.createDataFrame([("g", None, [], 1.5, None, None)], schemas.TOPICS["event.groups.v1"]).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    _, held = validate.validate(df, "event.groups.v1")
    assert sorted(x["rule"] for x in held.first()["violations"]) == ["minItems", "range"]



def test_search_scores(spark):
    docs = spark.createDataFrame([("a", "local_file", "README.md", "setup", 0.92), ("b", "entity", "Acme", None, 0.88), ("c", "web_doc", "Docs", "readme", 0.8), ("d", "other", "x", "y", None)], "id string, kind string, title string, snippet string, score double")
    got = {r["id"]: round(r["score"], 6) for r in search.search(docs, "README", "local").collect()}
    assert got == {"a": 1.0, "b": 0.9, "c": 0.9, "d": 0.5}
    assert [r["id"] for r in search.search(docs, "README", "local").collect()] == ["a", "b", "c", "d"]


def test_recent_queries(spark):
    log = spark.createDataFrame([(1, " a ", 1), (1, "b", 2), (1, "a", 3), (1, "  ", 4)] + [(2, f"q{i}", i) for i in range(30)], "user int, q string, ts int")
    got = search.recent_queries(log).collect()
    assert [r["q"] for r in sorted(got, key=lambda r: r["rank"]) if r["user"] == 1] == ["a", "b"] and sum(r["user"] == 2 for r in got) == 20


def test_routes(spark):
    df = spark.createDataFrame([("a b/(c)", "entity"), ("x~'", "local_file"), ("é", "web")], "id string, kind string")
    assert [r["route"] for r in search.entity_route(df).collect()] == ["/entity/company/a%20b%2F(c)", "/entity/file/x~'", "/entity/doc/%C3%A9"]


def test_provenance_truth_table(spark):
    full = {"git": "g", "images": {}, "schemas": None, "offsets": 0}
    cases = [("completed", full, True), ("failed", full, False), ("completed", {**full, "git": False}, False), ("completed", {k: v for k, v in full.items() if k != "offsets"}, False), ("completed", None, False)]
    df = spark.createDataFrame([(s, json.dumps(p) if p is not None else None, w) for s, p, w in cases], "status string, provenance string, want boolean")
    assert all(r["allowed"] == r["want"] for r in evaluate.provenance_gate(df).collect())


def test_targets_drift_and_tasks(spark):
    m = spark.createDataFrame([("a", "component"), ("b", "adapter"), ("c", "docs")], "name string, role string")
    assert rows(fleet.select_targets(m, ["b"], "docs", True).select("name")) == [("b",)]
    assert rows(fleet.select_targets(m, None, "docs", True).select("name")) == [("a",)] and fleet.select_targets(m).count() == 0
    lock = spark.createDataFrame([("a", "1"), ("b", None)], "name string, rev string")
    head = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "3")], "name string, rev string")
    assert {r["name"]: r["drift"] for r in fleet.lock_drift(m, lock, head).collect()} == {"a": True, "b": False, "c": False}
    files = spark.createDataFrame([("a", "justfile"), ("a", "Makefile"), ("b", "scripts/build.py")], "name string, path string")
    assert {r["name"]: r["contract"] for r in fleet.task_contract(m, files, "build").collect()} == {"a": "Makefile", "b": "scripts/build.py", "c": "no contract"}
    res = spark.createDataFrame([(1, 1, "ran", 3), (1, 2, "missing", None), (1, 3, "ran", 0), (2, 1, "ran", 0), (3, 1, "missing", None), (3, 2, "ran", 5)], "batch int, position int, outcome string, code int")
    assert {r["batch"]: r["exit_code"] for r in fleet.run_rollup(res).collect()} == {1: 2, 2: 0, 3: 5}


def test_unregistered_metrics(spark):
    p = spark.createDataFrame([("p", [("f1",), (None,), ("",), ("x.y",)])], "id string, metrics array<struct<name:string>>")
    assert rows(adaptation.unregistered_metrics(p, spark.createDataFrame([("f1",)], "id string"))) == [("p", "__missing__"), ("p", "__missing__"), ("p", "x.y")]


def test_metric_registry_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("metrics:\n  - id: a.f1\n    kind: quality\n    range: [0, 1]\n    dimensions: [split, topic]\n  - id: drift\n    range: [0, null]\n")
    got = topics.read_metric_registry(spark, str(tmp_path / "r.yaml")).collect()
    assert [(r["id"], r["range"]) for r in got] == [("a.f1", [0.0, 1.0]), ("drift", [0.0, None])] and got[0]["dimensions"] == ["split", "topic"]


def test_inventory_file_and_written_topics(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("path\tkind\tbytes\tpath_repr\na/b.md\tfile\t0\tx\n")
    assert rows(topics.read_inventory_tsv(spark, str(tmp_path / "i.tsv"))) == [("a/b.md", "file", 0, "x")]
    df = spark.createDataFrame([("l", "s", "m")], "log_id string, source string, message string").withColumn("observed_at", F.lit("2024-01-02 03:00:00").cast("timestamp"))
    topics.write_artifacts(df, "normalized.logs.v1", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("topic = 'normalized.logs.v1' AND event_date = '2024-01-02'").count() == 1


def test_pooling_argmax_and_edits(spark):
    t = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [5.0, 5.0])], "doc_id int, pos int, mask int, vector array<double>")
    assert {r["doc_id"]: r["embedding"] for r in contenders.pool_embeddings(t).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    assert {r["doc_id"]: r["embedding"] for r in contenders.pool_embeddings(t, "cls").collect()} == {1: [1.0, 2.0], 2: [5.0, 5.0]}
    df = spark.createDataFrame([([1.0, 3.0, 3.0], "a b c d", "a x c"), ([0.0], "", "q")], "l array<double>, r string, h string")
    assert [r[0] for r in df.select(contenders.argmax_label(F.col("l"))).collect()] == [1, 0]
    assert contenders.wer(df.withColumn("g", F.lit(1)), ["g"], "r", "h").first()["edits"] == 3


def test_negative_threshold_promotes_on_less(spark):
    m = spark.createDataFrame([("asr", "wer", "champion", 0.2), ("asr", "wer", "challenger", 0.18), ("emb", "cos", "champion", 0.5), ("emb", "cos", "challenger", 0.5)], "task string, metric string, role string, value double")
    p = spark.createDataFrame([("asr", "wer", -0.01), ("emb", "cos", 0.002)], "task string, metric string, threshold double")
    assert {r["task"]: r["promote"] for r in contenders.compare_contenders(m, p).collect()} == {"asr": True, "emb": False}


def test_graphs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in components.connected(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    cycle = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "b")], "src string, dst string")
    got = {r["node"]: r["path"] for r in incidents.topology_path(cycle, spark.createDataFrame([("r",)], "start string"), 9).collect()}
    assert got == {"r": ["r"], "a": ["r", "a"], "b": ["r", "b"]}


def test_severity_and_conflicts(spark):
    df = spark.createDataFrame([("debug",), ("critical",), ("odd",), (None,)], "s string").select(normalize.severity_rank(F.col("s")).alias("r"))
    assert [r["r"] for r in df.collect()] == [0, 5, None, None]
    c = spark.createDataFrame([("k", 1, "a1", "x"), ("k", 2, "a2", "y"), ("k", 3, "a3", "x"), ("j", 1, "a1", "z")], "key string, layer int, artifact_id string, payload string")
    one = lambda s, p=None: {r["key"]: r["payload"] for r in adaptation.resolve_conflicts(c, s, p).collect()}
    assert one("ranked_layers") == {"k": "x", "j": "z"} and one("pinned_overrides", ["a2"]) == {"k": "y", "j": "z"} and one("vote") == {"k": "x", "j": "z"} and one("deny_on_conflict") == {"j": "z"}
    v = spark.createDataFrame([("a", "1.2.10", "approved"), ("a", "1.10.2", "approved"), ("a", "9.0.0", "banned")], "id string, version string, status string")
    assert adaptation.current_artifacts(v).first()["version"] == "1.10.2"

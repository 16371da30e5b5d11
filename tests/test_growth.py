"""Steps whose work must follow the input: what they make on the way, and their results against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators import adaptation as ad
from eventloom.operators import components, evaluate, fleet, incidents, lexical, search
from eventloom.plans import workspace


def test_approximate_topk_makes_no_row_for_each_pair(spark):
    """600 near vectors share every bucket; rows for pairs would be 600 times 600 times 4 tables."""
    r = random.Random(2)
    rows = [(i, [1.0 + r.random() / 9, r.random() / 9, r.randint(0, 1) / 9]) for i in range(600)] + [(600, None), (601, [-9.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = incidents.similar_topk_approx(d, d, 3, 1.0, bucket=4.0, tables=4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = d.where("embedding IS NOT NULL").collect()
    far = {x["id"]: sorted((round(sum((a - b) ** 2 for a, b in zip(x["embedding"], y["embedding"], strict=True)), 8), y["id"]) for y in rows if y["id"] not in (x["id"], 601))[:3] for x in rows if x["id"] != 601}
    found = {(x["ref_id"], x["rank"]): 2 - 2 * x["score"] for x in got.collect()}
    assert found == {(i, n): pytest.approx(x[0], abs=1e-7) for i, near in far.items() for n, x in enumerate(near, 1)}


def test_rollup_of_equal_positions(spark):
    """The first in the table counts, in whatever order rows arrive."""
    rows = [(1, 5, "ran", i % 7 + 1, i) for i in range(200)] + [(1, 5, "ran", 0, -1), (1, 4, "ran", 9, -5), (2, 1, "ran", 0, 0)]
    for n in (1, 5):
        for seed in range(3):
            d = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "batch int, position int, outcome string, code int, place int")
            assert {r["batch"]: r["exit_code"] for r in fleet.run_rollup(d.repartition(n)).collect()} == {1: 1, 2: 0}


def test_rollup_of_odd_line_items(spark, tmp_path):
    """Quantities between whole numbers round as the SQL's cast does, and a line item without a number or part is last of nothing."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(4)
    some = lambda x, n: None if r.random() < 1 / n else x
    rows = [(some(r.randint(0, 300), 50), some(i, 4), some(r.randint(1, 7), 4), some(r.randint(-9, 99) / 4, 9), some(r.choice("ANR"), 9), some(r.choice("FO"), 9)) for i in range(1500)]
    rows += [(400, None, 3, 5.0, "A", "F"), (400, 7, 1, 4.0, "R", "F"), (401, None, None, 5.0, "A", "F"), (402, 1, 1, 2.5, "R", "F"), (402, 2, 2, 3.5, "R", "F")]
    cols = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = workspace.Q["wsp05_run_rollup"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(workspace.SQL["wsp05_run_rollup"]).fetchall()))
    assert {x["batch"]: x["exit_code"] for x in got if x["batch"] in (400, 401, 402)} == {400: 1, 401: 0, 402: 1}


def test_last_of_a_key_needs_no_join_by_key(spark, request):
    """Nearly all runs are of one scenario: no shuffle by scenario may carry the runs."""
    rows = [(f"r{i:05}", "big" if i % 50 else f"s{i % 7}", "completed" if i % 3 else "failed", i // 4) for i in range(3000)] + [("x", None, "failed", 3), ("y", None, "completed", 2)]
    d = spark.createDataFrame(rows, "run_id string, scenario string, status string, started_at long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit))
    got = evaluate.run_history(d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort ?MergeJoin|ShuffledHashJoin", plan)
    last = {}
    for run, scenario, _, at in sorted(rows, key=lambda x: (x[3], x[0])):
        last[scenario] = run
    assert {x["scenario"]: x["run_id"] for x in got.where("latest").collect()} == last and got.where("NOT latest").count() == len(rows) - len(last)


def test_topics_read_the_texts_a_fixed_number_of_times(spark):
    """The number of jobs that tokenise must not follow the rounds of the fit."""
    read = spark.sparkContext.accumulator(0)

    def count(x):
        read.add(1)
        return x

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 23}" for j in range(1, 9))) for i in range(60)], "doc_id long, text string")
    docs = docs.select("doc_id", F.udf(count)("text").alias("text"))
    for method in ("lsi", "lsa", "lda"):
        before = read.value
        ad.fit_topics(docs, method, k=2, rounds=8)
        assert read.value - before <= 2 * 60


def test_rounds_of_components_shrink(spark, monkeypatch):
    """A chain in the order of its names, a star and pairs: what all rounds write stays within a few times the input."""
    r, written = random.Random(4), []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: (lambda t: (written.append(t.count()), t)[1])(cut(df)))
    links = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1500)] + [("hub", f"s{i}") for i in range(400)] + [(f"p{i}", f"q{i}") for i in range(50)] + [("p1", "p1"), (None, "p2")]
    r.shuffle(links)
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(links * 2, "a string, b string")).collect()}
    want = {f"c{i:04}": "c0000" for i in range(1501)} | {f"s{i}": "hub" for i in range(400)} | {"hub": "hub"} | {f"{c}{i}": f"p{i}" for c in "pq" for i in range(50)}
    assert got == want and sum(written) < 12 * len(links)


def test_long_queries_make_no_row_for_each_document(spark):
    """Whole texts as queries: the rows that leave the tasks are k a query and block, not a document."""
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join([*(f"c{r.randrange(30)}" for _ in range(20)), *(f"x{r.randrange(500)}" for _ in range(9))])) for i in range(900)], "doc_id int, text string")
    q = docs.where("doc_id < 60").withColumnRenamed("doc_id", "query_id")
    words = q.select("query_id", F.explode(F.array_distinct(lexical.tokens(F.col("text")))).alias("term"))
    post = lexical.postings(docs, words, 1.2, 0.75)[0].cache()
    top = lexical.multiplied(post, words, 3)
    assert "FlatMapCoGroupsInPandas" in top._jdf.queryExecution().optimizedPlan().toString()
    sums = {}
    for x in words.join(post, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("s")).collect():
        sums.setdefault(x["query_id"], []).append((-x["s"], x["doc_id"]))
    want = {(i, d, n) for i, found in sums.items() for n, (_, d) in enumerate(sorted(found)[:3], 1)}
    assert {(x["query_id"], x["id"], x["rank"]) for x in top.collect()} == want
    assert "multiplied" in lexical.lexical_search.__code__.co_names


def most_in_one_part(df):
    """The share of df's rows that the fullest partition has."""
    n = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_pairs_of_a_hot_entity_are_made_in_many_tasks(spark):
    """One entity has nearly all mentions, in one partition; times before 1970 and equal times are among them."""
    r = random.Random(6)
    rows = [(f"r{i:04}", "service", "hot" if i % 40 else f"s{i % 3}", r.randint(-40_000, 40_000)) for i in range(2500)] + [("x", "service", "hot", None), ("y", "service", None, 5)]
    m = spark.createDataFrame(rows, "record_id string, kind string, id string, s long").coalesce(1).withColumn("at", F.timestamp_seconds("s"))
    for gap in (0, 1, 1800):
        got = incidents.correlate_pairs(m, gap)
        want = [(a, b, "service", x) for a, _, x, s in rows[:2500] for b, _, y, t in rows[:2500] if x == y and 0 <= t - s <= gap and (t > s or a < b)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert most_in_one_part(got) < 0.5


def test_pairs_of_one_moment_are_made_in_many_tasks(spark, monkeypatch):
    """Most mentions of an entity are of one second, so of one bucket; buckets beside it have few, and one before it many."""
    monkeypatch.setattr(incidents, "HOT", 60)
    r = random.Random(7)
    rows = [(f"r{i:04}", "service", "hot", 7200) for i in range(900)] + [(f"s{i:04}", "service", "hot", 7200 - r.randint(1, 900)) for i in range(300)]
    rows += [(f"t{i:04}", "service", "hot" if i % 2 else "cold", r.randint(-9000, 14_000)) for i in range(300)] + [("x", "service", "hot", None), ("y", "service", None, 7200), ("y", "service", None, 7200)]
    m = spark.createDataFrame(rows, "record_id string, kind string, id string, s long").coalesce(1).withColumn("at", F.timestamp_seconds("s"))
    for gap in (1, 1801):
        got = incidents.correlate_pairs(m, gap)
        want = [(a, b, "service", x) for a, _, x, s in rows[:1500] for b, _, y, t in rows[:1500] if x == y and 0 <= t - s <= gap and (t > s or a < b)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert most_in_one_part(got) < 0.5


def test_runs_of_a_hot_ancestor_meet_in_many_tasks(spark, monkeypatch):
    """Nearly all artifacts and runs belong to one ancestor; one ancestor has no run and one run no artifact below it."""
    monkeypatch.setattr(ad, "RUNS", 50)
    monkeypatch.setattr(ad, "BELOW", 40)
    inputs = [(f"a{i}", "hot" if i % 20 else "few") for i in range(200)] + [("hot", "top"), ("none", "a3"), ("none", None)]
    runs = [("hot" if i % 30 else "few", f"run{i}", "m", float(i)) for i in range(300)] + [("a3", "run1", "m", None), ("a3", "run1", "k", 2.0), ("lost", "z", "m", 1.0), (None, "z", "m", 1.0)]
    d = spark.createDataFrame(inputs, "artifact string, input string").coalesce(1)
    got = ad.artifact_lineage(d, spark.createDataFrame(runs, "artifact string, run_id string, metric string, value double").coalesce(1))
    want = []
    for x in ad.artifact_lineage(d).collect():
        own = [r[1:] for r in runs if r[0] == x["ancestor"]] or [(None, None, None)]
        want += [(x["artifact"], x["ancestor"], x["distance"], *r) for r in own]
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(got.collect()) == key(want) and len(want) > 50_000
    assert most_in_one_part(got) < 0.6


def test_runs_of_many_small_ancestors_meet_in_few_tasks(spark):
    """As many tasks as the rows need, not one for each ancestor."""
    d = spark.createDataFrame([(f"a{i % 700}", f"p{i % 300}") for i in range(2100)], "artifact string, input string")
    runs = [(f"p{i % 310}", f"run{i}", "m", float(i)) for i in range(900)]
    got = ad.artifact_lineage(d, spark.createDataFrame(runs, "artifact string, run_id string, metric string, value double"))
    n = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == sum(sum(1 for r in runs if r[0] == x["ancestor"]) or 1 for x in ad.artifact_lineage(d).collect())
    assert len(n) < 20


def test_documents_are_dealt_by_their_mentions(spark, monkeypatch):
    """Rows of one task stay as many, whatever the shuffle partitions are; a document above a tile stands among small ones."""
    monkeypatch.setattr(search, "PART", 100)
    monkeypatch.setattr(search, "TILE", 9)
    r = random.Random(3)
    docs = {d: [r.randrange(60) for _ in range(r.randint(0, 9))] for d in range(300)} | {300: [*range(40)] * 2, 301: [5] * 30, 302: [5] * 9}
    df = spark.createDataFrame([(d, e) for d, es in docs.items() for e in es] + [(3, None), (None, 1)], "doc_id int, entity int").coalesce(1)
    got = search.co_mentions(df)
    want = sorted((d, a, b) for d, es in docs.items() for a in set(es) for b in set(es) if a < b)
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(search, "TILE", 100)
    assert search.co_mentions(df).select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ingest_writes_texts_once(spark, tmp_path, monkeypatch):
    """Only the batch itself goes through a table between jobs with its texts; nulls, equal versions and repeats by a plain version."""
    r, written = random.Random(7), []
    monkeypatch.setattr(search, "cut", lambda df, cut=search.cut: (written.append("text" in df.columns), cut(df))[1])
    shape, path, store = "id int, text string, version int", str(tmp_path / "store"), {}
    for n in range(4):
        rows = [(r.randrange(60), r.choice([None, "", "a", "b", "c"]), r.choice([None, 1, 2, 3, 4])) for _ in range((5, 90, 0, 60)[n])]
        actions = {}
        for i in {x[0] for x in rows}:
            t, v = min(((t, v) for j, t, v in rows if j == i), key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is not None, x[0] or ""))
            o = store.get(i)
            new = o is not None and None not in (v, o[1], t, o[0]) and v > o[1] and t != o[0]
            actions[i] = "insert" if o is None else "update" if new else "keep"
            store[i] = (t, v) if actions[i] != "keep" else o
        written.clear()
        got = search.ingest_into(spark.createDataFrame(rows, shape), path, 8)
        assert sum(written) == 1
        again = search.ingest_into(spark.createDataFrame(rows, shape), path, 8)
        assert sorted(map(tuple, got.collect())) == sorted(actions.items()) and {x["action"] for x in again.collect()} <= {"keep"}
        assert {x["id"]: (x["text"], x["version"]) for x in spark.read.parquet(path).collect()} == store
    got = search.ingest_documents(spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "x", 1)], shape), spark.createDataFrame([(1, "z", 1, "h"), (3, "y", 1, "g")], f"{shape}, hash string"))
    assert sorted((x["id"], x["text"], x["version"], x["action"]) for x in got.collect()) == [(1, "a", 2, "update"), (2, "x", 1, "insert"), (3, "y", 1, "keep")]

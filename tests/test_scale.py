"""Forms that hold at scale against their plain versions."""

import random
from statistics import median

from pyspark.sql import functions as F

from eventloom.functions import vectors
from eventloom.functions.medians import group_medians
from eventloom.operators import incidents


def test_group_medians(spark):
    r = random.Random(3)
    groups = {f"g{n}": [r.choice([r.random(), 0.5, -1.0]) for _ in range(n)] for n in [*range(1, 13), 999, 1000, 5001]} | {"same": [2.0] * 40, None: [1.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("g3", None), ("none", None)]
    got = {x["g"]: x["median"] for x in group_medians(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    assert got == {g: median(vs) for g, vs in groups.items()} | {"none": None}


def test_block_topk_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-1, 1)) for _ in range(3)]) for i in range(90)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id int, embedding array<float>")

    def cos(a, b):
        n = (sum(x * x for x in a or []) * sum(x * x for x in b or [])) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    want = {(q, i, k) for q, x in rows if q % 5 == 0 for k, (_, i) in enumerate(sorted((-max(0.0, cos(x, y)), i) for i, y in rows if i != q)[:4], 1)}
    got = incidents.similar_topk(d, d.where("id % 5 = 0"), 4).collect()
    assert {(x["ref_id"], x["id"], x["rank"]) for x in got} == want and len(got) == len(want)
    none = d.limit(0)
    assert incidents.similar_topk(d, none, 4).count() == 0 and incidents.similar_topk(none, d, 4).count() == 0


def test_approximate_topk_finds_nine_in_ten(spark):
    from eventloom import registry

    sf = "/root/testdata/sf0.01"
    exact, near = (registry.queries()[n](spark, sf).select("ref_id", "id") for n in ("sim02_similar_topk", "sim03_similar_topk_approx"))
    exact = exact.cache()
    assert exact.join(near, ["ref_id", "id"]).count() >= 0.9 * exact.count()


def test_consecutive_pairs_give_the_components_of_all_pairs(spark):
    r = random.Random(9)
    rows = [(f"r{i}", "user", f"u{r.randint(0, 5)}", r.randint(0, 20_000)) for i in range(200)]
    m = spark.createDataFrame(rows, "record_id string, kind string, id string, s long").withColumn("at", F.timestamp_seconds("s"))
    some, every = (incidents.group_components(f(m, 300)).collect() for f in (incidents.consecutive_pairs, incidents.correlate_pairs))
    assert set(some) == set(every) and len(some) == len(every)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import negatives, queries


def brute(rows, positives=5, negs=3, every=50):
    """rows: (id, label, x)."""
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: B905, E731
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for i, (a, label, x) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(dot(x, r[2]), r[0], r[1]) for j, r in enumerate(rows) if j != i]
        for p, b, _ in first([s for s in scored if s[2] == label])[:positives]:
            found = first([s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p])[:negs]
            out += [(a, b, k, n, p, s) for k, (s, n, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=50):
    df = spark.createDataFrame(rows, "id long, label int, x array<long>").withColumns({"row": F.lit(1), "windows": F.lit(2), "score": F.lit(3), "a.b": F.lit(4)}).repartition(3)
    got = negatives.hard_negatives(df, F.coalesce(F.col("id") % every == 0, F.lit(False)))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("width", [3, 20])
def test_hard_negatives(spark, monkeypatch, width):
    """Small whole numbers with many ties, a hot label, copies, null ids, short and empty vectors; several blocks of each side."""
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    rng = random.Random(width)
    top = 2 if width == 3 else 60
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), [rng.randint(-top, top) for _ in range(width)]) for i in range(150)]
    rows += [(200 + i, i % 3, rows[10][2]) for i in range(30)] + [(None, 1, [top] * width), (None, 0, rows[0][2]), (300, 2, []), (310, 2, [top]), (320, None, [1] * width), (330, 1, None), (340, 7, [top] * width), (350, 8, [0] * width)]
    assert mined(spark, rows, 10) == brute(rows, every=10)


def test_hard_negatives_of_large_values_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.randint(-(2**27), 2**27) for _ in range(6)]) for i in range(60)]
    assert mined(spark, rows, 10) == brute(rows, every=10)
    assert mined(spark, rows[1:2], 10) == [] and negatives.hard_negatives(spark.createDataFrame([], "id long, label int, x array<long>"), F.lit(True)).count() == 0
    assert mined(spark, [(0, 1, [2]), (0, 1, [2]), (1, 2, [1])], 10) == brute([(0, 1, [2]), (0, 1, [2]), (1, 2, [1])], every=10) == [(0, 0, 1, 1, 4, 2)] * 2


def test_postings_leave_out_what_bounds_cover():
    """Every pair at or above the threshold is found with its exact score, and weak dimensions are not indexed."""
    rng = np.random.default_rng(4)
    rows = np.round(rng.normal(size=(500, 40)) * 100 / np.arange(1, 41) ** 1.5).astype(float)
    x, least = rows[:50].copy(), np.round(rng.uniform(3000, 20000, 50))
    most = float(np.linalg.norm(x, axis=1).max())
    index = negatives.Postings(rows, most, float(least.min()))
    assert sum(b.size for _, b in index.blocks) < 0.5 * rows.size
    a, j, score = index.join(x, least)
    full = x @ rows.T
    want = {(i, k): full[i, k] for i, k in zip(*np.nonzero(full >= least[:, None]), strict=True)}
    assert {(i, k): s for i, k, s in zip(a.tolist(), j.tolist(), score.tolist(), strict=True)} == want and len(a) == len(want)


def test_whole_numbers(spark):
    rows = [(1, [0.5, -0.001], 3), (2, [float("nan"), 1.0], 1), (3, [float("inf")], 1), (4, [None, 1.0], 1), (5, None, 1), (6, [1.0], None), (7, [], 2)]
    got = negatives.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 3, [128, -1]), (7, 2, [])]


def test_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(queries.OP13_SQL).fetchall()
    got = queries.op13_hard_negatives(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100

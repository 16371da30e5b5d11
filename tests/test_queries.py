"""Every registered query against its SQL over the smallest tables; stream and late-row cases."""

import json

import pytest

from eventloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canon(df):
    show = lambda x: "null" if str(x) in ("None", "nan", "<NA>", "NaT") else str(round(float(x), 6) + 0.0) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)
    return sorted(json.dumps([show(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_late_rows_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    from eventloom.streaming import streams

    one = lambda ts, ids: spark.createDataFrame([(t, "s", i) for t, i in zip(ts, ids, strict=True)], "t string, source string, id int").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    one(["2024-01-01 00:00:00", "2024-01-01 02:00:00"], [1, 2]).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("source string, id int, at timestamp").parquet(str(tmp_path / "in"))
    args = ["at", 600, *[str(tmp_path / x) for x in ("good", "late", "state", "ck")]]
    streams.stream_late(read(), *args)
    one(["2024-01-01 00:30:00", "2024-01-01 03:00:00"], [3, 2]).write.mode("append").parquet(str(tmp_path / "in"))
    streams.stream_late(read(), *args)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [3]
    out = streams.run_to_table(streams.stream_dedupe(read(), "at", "5 hours"), str(tmp_path / "d"))
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]

from eventloom.operators import adaptation as ad


def test_dictionary_of_long_terms(spark):
    docs = spark.createDataFrame([(1, "He said: no such TERM here, no.")], "doc_id long, text string")
    terms = spark.createDataFrame([("no such term here",), ("no",), (None,)], "term string")
    assert {(r["term"], r["n"]) for r in ad.apply_dictionary(docs, terms).collect()} == {("no such term here", 1), ("no", 2)}


def test_lineage_of_52_steps(spark):
    got = ad.artifact_lineage(spark.createDataFrame([(i, i + 1) for i in range(52)], "artifact int, input int"))
    assert got.count() == 52 * 53 // 2 and got.agg({"distance": "max"}).first()[0] == 52

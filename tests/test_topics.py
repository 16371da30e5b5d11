"""Singular-vector topics against numpy, with fixed signs; centroids and their references."""

import numpy as np
import pytest

from eventloom.operators import adaptation as ad

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("method", ["lsi", "lsa"])
def test_axes_and_memberships_equal_numpy(spark, method):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    v, words, axes = ad.fit_topics(docs, method, k=4)
    rows = v.orderBy("doc_id").collect()
    x = np.array([r["v"].toArray() for r in rows])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    _, got = ad.singular_axes(v, 4)
    assert np.allclose(got, s[:4], rtol=1e-6, atol=0)
    want = vt[:4].T
    top = want[np.abs(np.round(want, 9)).argmax(axis=0), range(4)]
    want = want * np.sign(top)
    assert axes.shape == (len(words), 4) and np.allclose(axes, want, atol=1e-6)
    cos = (x @ want) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    m = {(r["doc_id"], r["topic_id"]): r["membership"] for r in ad.topic_membership(v, axes, f"{method}_cosine").collect()}
    assert len(m) == 4 * len(rows)
    assert max(abs(m[r["doc_id"], k] - cos[i, k]) for i, r in enumerate(rows) for k in range(4)) < 1e-6


def test_membership_of_dense_and_empty_vectors(spark):
    from pyspark.ml.linalg import Vectors

    v = spark.createDataFrame([(1, Vectors.dense([3.0, 4.0])), (2, Vectors.sparse(2, [1], [2.0])), (3, Vectors.sparse(2, [], []))], ["doc_id", "v"])
    got = {(r["doc_id"], r["topic_id"]): round(r["membership"], 9) for r in ad.topic_membership(v, np.array([[1.0, 0.0], [0.0, 2.0]]), "lsi_cosine").collect()}
    assert got == {(1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.0, (2, 1): 1.0, (3, 0): 0.0, (3, 1): 0.0}


def test_centroid_references(spark, tmp_path):
    c = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0), (1, 1, 6.0)], "topic_id int, dim int, x double")
    refs = {r["topic_id"]: r["centroid_embedding_ref"] for r in ad.store_centroids(c, f"{tmp_path}/c", "s1").collect()}
    assert refs == {0: f"{tmp_path}/c#s1/0", 1: f"{tmp_path}/c#s1/1"}
    more = ad.store_centroids(c.where("topic_id = 1"), f"{tmp_path}/c", "s2")
    ad.store_centroids(c.where("topic_id = 0"), f"{tmp_path}/c", "s2")
    assert {r["topic_id"]: r["centroid"] for r in ad.read_centroids(spark, spark.createDataFrame([(refs[1],)], "centroid_embedding_ref string").selectExpr("1 AS topic_id", "*")).collect()} == {1: [5.0, 6.0]}
    assert spark.read.parquet(f"{tmp_path}/c").where("space = 's2'").count() == 1 and more.columns == ["topic_id", "centroid_embedding_ref"]
    assert ad.read_centroids(spark, more.limit(0)).count() == 0

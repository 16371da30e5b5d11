import random

from eventloom.llm import counts, queries

from .test_operators import clashing, docs_of, odd, prose  # noqa: F401

PATH = queries.tokenizer_path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


STRANGE = [
    "A<|endoftext|>B <|endoftext|> it's", "<|startoftext|", "<|endoftext|><|startoftext|>x", "Ångström Ångström e ́x", "İΣΣ Σ ǅ", "x\x1cy\x00z\x85w　v u", "don't CAN'T 'Sx 12345 !!'s ''s", "\U0001f600\U0001f468‍\U0001f469 ﻿", "a" * 3000 + " " + "!" * 500,
    "각 가", "  a�", "tail \n", "x" * 90 + " " + "y" * 90,
]


def test_token_counts(spark, odd, monkeypatch):  # noqa: F811
    """Against the library, with most pre-tokens joined, a few known to the tasks, and slices of a few texts."""
    rng = random.Random(8)
    texts = [*odd, *STRANGE, *(prose(rng, rng.randrange(200)) for _ in range(60))]
    want = [(i, len((t or "").encode()), n, n > 100) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    for known, size in ((3, 2000), (counts.FREQUENT, counts.SLICE)):
        monkeypatch.setattr(counts, "FREQUENT", known)
        monkeypatch.setattr(counts, "SLICE", size)
        monkeypatch.setattr(counts, "HELD", 50)
        got = counts.token_counts(clashing(docs_of(spark, texts)).repartition(3), PATH, ["doc_id"], 100)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(tuple, got.collect())) == want


def test_token_counts_of_repeated_and_clashing_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7.0), (1, "a b", 5, 6, 7.0), (None, "c's", 1, 2, None)], "doc_id long, text string, n_tokens int, of_row int, `a.b` double")
    got = counts.token_counts(df, PATH, ["doc_id", "n_tokens", "of_row", "a.b"])
    assert got.columns[:4] == ["doc_id", "n_tokens", "of_row", "a.b"]
    assert sorted((r[0] or 0, r[4], r[5]) for r in got.collect()) == [(0, 3, 2), (1, 3, 2), (1, 3, 2)]
    assert counts.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_pieces_of_distinct_pretokens(spark, odd):  # noqa: F811
    got = counts.pretoken_counts(docs_of(spark, [*odd, *odd]), PATH).collect()
    assert len({r["token"] for r in got}) == len(got) and all(r["n"] % 2 == 0 for r in got)
    specials = 0
    assert sum(r["n"] * r["pieces"] for r in got) + specials == 2 * sum(library(odd))


def test_registered_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r[0] for r in rows), library([r[1] for r in rows]), strict=True))
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op12_token_counts(spark, sf).collect()} == want

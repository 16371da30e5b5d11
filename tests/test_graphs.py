"""Graph steps, tiles of documents, ranked search and dictionaries at sizes that their plain forms don't reach."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.functions.vectors import edit_distance
from eventloom.operators import adaptation, components, lexical, search


def test_chain_of_2000_steps(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: (rounds.append(1), cut(df))[1])
    got = adaptation.artifact_lineage(spark.range(2000).select(F.col("id").alias("artifact"), (F.col("id") + 1).alias("input")))
    assert got.agg(F.count("*"), F.max("distance"), F.sum("distance")).first() == (2000 * 2001 // 2, 2000, sum(d * (2001 - d) for d in range(1, 2001)))
    assert len(rounds) <= 13  # the edges, eleven doublings, and one that finds nothing


def test_closure_of_random_graphs(spark):
    r = random.Random(8)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(55)} | {(k, k + 1) for k in range(100, 130)} | {(130, 100)}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def walk(s):
        paths, front = {s: (s,)}, [s]
        while front:
            step = {}
            for a in front:
                for b in near.get(a, ()):
                    if b not in paths:
                        p = (*paths[a], b)
                        step[b] = min(p, step.get(b, p))
            paths |= step
            front = list(step)
        return paths

    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    every = {s: walk(s) for s in {x for p in edges for x in p}}
    far = {(s, d): len(p) - 1 for s, ps in every.items() for d, p in ps.items() if d != s}
    assert {(x["src"], x["dst"]): x["distance"] for x in components.closure(e).collect()} == far
    starts = [0, 100, 115]
    for limit in (2, 11):
        hops = components.k_hop(e, spark.createDataFrame([(s,) for s in starts], "seed long"), limit, directed=True).collect()
        assert {(x["seed"], x["node"]): x["distance"] for x in hops} == {k: v for k, v in far.items() if k[0] in starts and v <= limit} | {(s, s): 0 for s in starts}
    for depth in (3, 60):
        got = components.shortest_paths(e, spark.createDataFrame([(0,), (100,)], "start long"), depth).collect()
        assert {(x["start"], x["node"]): tuple(x["path"]) for x in got} == {(s, d): p for s in (0, 100) for d, p in every[s].items() if len(p) - 1 <= depth}


def test_documents_of_many_entities_meet_in_tiles(spark, monkeypatch):
    big = spark.range(20_000).select(F.lit("big").alias("doc_id"), F.concat(F.lit("e"), F.col("id")).alias("entity"))
    pairs = search.co_mentions(big)
    assert pairs.agg(F.count("*"), F.count_if(F.col("src") >= F.col("dst"))).first() == (20_000 * 19_999 // 2, 0)
    monkeypatch.setattr(search, "TILE", 4)
    r = random.Random(1)
    docs = {d: {r.randrange(40) for _ in range(r.choice([1, 3, 30]))} for d in range(12)}
    df = spark.createDataFrame([(d, e) for d, es in docs.items() for e in es] * 2 + [(3, None), (None, 1)], "doc_id int, entity int")
    want = Counter((a, b) for es in docs.values() for a in es for b in es if a < b)
    assert {(x["src"], x["dst"]): x["weight"] for x in search.semantic_graph(df).collect()} == dict(want)


def bm25(docs, queries, k):
    cut = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    words = {d: Counter(cut(t)) for d, t in docs}
    n, mean = len(docs), sum(c.total() for c in words.values()) / len(docs)
    df = Counter(w for c in words.values() for w in c)
    out = set()
    for q, t in queries:
        own = set(cut(t))
        scored = {d: round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in own if c[w]), 9) for d, c in words.items() if own & c.keys()}
        out |= {(q, d, s, r) for r, (d, s) in enumerate(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("block", [3, 64])
def test_lexical_search_equals_full_scoring(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    r = random.Random(block)
    common, rare = [f"c{i}" for i in range(12)], [f"x{i}" for i in range(400)]
    text = lambda: " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(r.randrange(1, 40)))
    docs = [(i, text()) for i in range(300)] + [(i, docs_text) for i, docs_text in ((301, "c1 x1"), (302, "c1 x1"), (303, None), (304, "")) for _ in range(1)]
    queries = [(q, text()) for q in range(25)] + [(90, ""), (91, None), (92, "nowhere"), (93, "c0 c1 c2"), (94, "c1 x1")]
    got = search.lexical_search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, text string"), 10)
    assert {(x["query_id"], x["doc_id"], x["score"], x["rank"]) for x in got.collect()} == bm25(docs, queries, 10)
    assert search.lexical_search(spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, text string"), 10).count() == 0


def test_common_words_make_no_rows_for_most_documents(spark):
    """Every query shares common words with every document; a quarter of the documents become candidates."""
    r = random.Random(7)
    common = [f"c{i}" for i in range(30)]
    text = lambda: " ".join([*(r.choice(common) for _ in range(40)), *(f"x{r.randrange(3000)}" for _ in range(8))])
    docs = spark.createDataFrame([(i, text()) for i in range(3000)], "doc_id int, text string")
    q = spark.createDataFrame([(i, text()) for i in range(30)], "query_id int, text string").select("query_id", F.explode(F.array_distinct(lexical.tokens(F.col("text")))).alias("term")).cache()
    post, blocks = lexical.postings(docs, q, 1.2, 0.75)
    found, _ = lexical.candidates(post, q, blocks, 10)
    before = q.join(post, "term").select("query_id", "doc_id").distinct().count()
    assert before == 30 * 3000 and found.count() < 0.3 * before


def test_dictionary_of_50000_terms(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60_000)]
    terms = {" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(50_000)}
    some = r.sample(sorted(terms), 300)
    texts = [(i, " ".join(r.choice(["plain", "filler", "stuff"]) for _ in range(400)) + " " + " ".join(r.sample(some, 3)) + " no") for i in range(100)]
    docs, table = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(x["doc_id"], x["term"]): x["n"] for x in adaptation.apply_dictionary(docs, table).collect()}
    want = Counter()
    for d, t in texts:
        w = t.split()
        want.update((d, " ".join(w[i : i + n])) for n in range(1, 9) for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in terms)
    assert got == dict(want)
    first = table.select(F.split("term", " ").alias("t")).select("t", F.get("t", F.lit(0)).alias("first"))
    assert adaptation.term_places(docs, first).count() < 20 * len(want) < 403 * 100  # not each place, let alone each length


def test_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 90))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert edit_distance(a, b) == edit_distance(b, a) == row[-1]

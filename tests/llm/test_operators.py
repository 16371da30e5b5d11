import json
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe, common, components, fingerprints, jaccard, mixing, pii, quality, queries, secrets, toxicity, urls, warc

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi"]


def docs_of(spark, texts, ids=None, sources=("a", "b", None)):
    rows = [(i, t, ["en", "fr", None][i % 3] if i is not None else "en", sources[(i or 0) % len(sources)], len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "X"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Texts at the edges: null, empty, blank, one word, repeats, a very long one."""
    rng = random.Random(3)
    base = prose(rng, 60)
    return [None, "", " \n\t ", "one", "one two three four", "One two  three\nfour", base, base, base + " tail", base.replace("alpha", "omega", 1), prose(rng, 30), prose(rng, 30) + "\n" + "same line here\n" * 4, prose(rng, 20000), "é" * 3000 + " x", "\r\n".join(["a b"] * 30), "!!! ### " * 40]


def clashing(df):
    """df with extra columns whose names operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("size", "h", "w", "t", "a", "b", "n", "row", "base", "component", "cuts", "_h", "_key", "_text", "s")})


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2000)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == brute.components(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark)).count() == 0


def test_jaccard(spark, odd):
    rng = random.Random(11)
    texts = list(odd)
    for _ in range(25):
        w = prose(rng, rng.randrange(6, 120)).split()
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    ids = [10 + 3 * i for i in range(len(texts))]
    got = jaccard.jaccard_components(clashing(docs_of(spark, texts, ids)))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute.jaccard(list(zip(ids, texts, strict=True)))


def test_jaccard_blocks(spark, monkeypatch):
    """One large group of near copies and a common passage, with lists longer than a block."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    base, passage = prose(rng, 40).split(), prose(rng, 12)
    texts = []
    for i in range(60):
        v = list(base)
        v[rng.randrange(40)] = f"q{i}"
        texts.append(" ".join(v))
    texts += [passage + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(2, 5))) for i in range(40)]
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()} == brute.jaccard(list(enumerate(texts)))


def test_jaccard_derives(spark, monkeypatch):
    """Groups of near copies next to each other, at both sides of the threshold; every hot key is dealt to parts."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCKS", 1)
    monkeypatch.setattr(jaccard, "HOT", 2)
    rng = random.Random(20)
    base, texts = prose(rng, 120).split(), []
    for cut in (0, 8, 14, 20, 40):
        head = [*base[: 120 - cut], *(f"z{cut}x{j}" for j in range(cut))]
        for i in range(12):
            v = list(head)
            if i:
                v[rng.randrange(120)] = f"q{cut}x{i}"
            texts.append(" ".join(v))
    for n in range(25):
        v = list(base)
        for j in range(n % 7):
            v[(n * 17 + j * 19) % 120] = f"p{n}x{j}"
        texts.append(" ".join(v))
    order = list(range(len(texts)))
    rng.shuffle(order)
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs_of(spark, [texts[i] for i in order])).collect()} == brute.jaccard([(k, texts[i]) for k, i in enumerate(order)])
    # one id with several sets
    rows = [(k % 50, texts[i]) for k, i in enumerate(order)]
    sets = [brute.shingles(t) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = brute.components(range(50), links)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r[0], r[2]) for r in got} == set(want.items())


def test_jaccard_ids(spark):
    t = prose(random.Random(1), 30)
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (7, t), (7, "other words stand here for once"), (9, "Other words stand here for once")], "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(df).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r[0], r[2]) for r in got] == [(4, 4), (4, 4), (7, 4), (7, 4), (9, 4), (None, None)]
    kept = jaccard.keep_first(df).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == [(False, 4), (False, 4), (True, 0)]
    assert jaccard.jaccard_components(df.where("doc_id < 0")).count() == 0


def test_long_text_in_segments(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [prose(rng, 3000), None, "", "x" * 5000 + " y z", prose(rng, 4)]
    whole = [s.tolist() for _, s in common.each_set(pa.array(texts))]
    monkeypatch.setattr(common, "SEGMENT", 700)
    assert [s.tolist() for _, s in common.each_set(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(brute.shingles(t)) for t in texts]


def test_mixing(spark, odd):
    rng = random.Random(6)
    texts = list(odd) + [prose(rng, rng.randrange(1, 60)) for _ in range(400)]
    df = clashing(docs_of(spark, texts, sources=("a", "b", None, "c", "a", "a")))
    got = mixing.mix(df).collect()
    size = {i: len(brute.WORD.findall(t or "")) for i, t in enumerate(texts)}
    sums = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["size"]
    want = brute.targets(sums)
    for s in sums:
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) for r in mine) and {r["source_size"] for r in mine} == {sums[s]}
        most = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= most
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    rows = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] * size[r[0]] for r in rows} == {i: t for i, t in again.items() if t}
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.where("doc_id < 0")).count() == 0


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = list(odd) + ["<|endoftext|>a<|endoftext|><|endoftext|> b", "日本語 🙂🙂 ñandú", "a  b   c\n d \n\n  e\u00a0 f \u3000 g ", "  two", "a \t", "x\x1c \x85 y", " " * 50, "----====" * 30] + ["".join(rng.choice("abcdeéß語🙂 \n'.-0123ABC") for _ in range(rng.randrange(1, 120))) for _ in range(200)]
    df = docs_of(spark, texts)
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.tokenise(df, path, ["doc_id"]).collect()}
    want = {i: e.ids for i, e in enumerate(lib.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert ids == want
    back = bpe.detokenise(bpe.tokenise(df, path, ["doc_id"]), path).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.digests(clashing(df), path, ["doc_id", "lang"]).collect():
        x = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x), brute.sha(",".join(map(str, x))), brute.sha(lib.decode(x, skip_special_tokens=False)))
    # verification accepts exactly the right proposals
    with open(path, encoding="utf-8") as f:
        v = bpe.load(f.read()).v
    import numpy as np

    for p in {p for t in texts for p in bpe.Encoder(v).pieces((t or "")[:4000])} - set(v.special):
        g = np.array(v.greedy(p.encode()))
        assert bool(v.compatible(g[:-1], g[1:]).all()) == (g.tolist() == v.exact(p.encode()))
    assert bpe.digests(df.where("doc_id < 0"), path, ["doc_id"]).count() == 0
    # extra columns of any name stay, ids is replaced
    every = bpe.tokenise(clashing(df).withColumns({"ids": F.lit("x"), "c d": F.lit(2)}), path)
    assert every.columns == [*clashing(df).columns, "c d", "ids"] and {r["doc_id"]: list(r["ids"]) for r in every.collect()} == want
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="byte-level"):
        bpe.refuse_others(other)


def test_pii(spark, odd):
    rng = random.Random(9)
    bits = ["a.b@c.d", "x@y", "a@b.c_d@e.f.g", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "4539578763621486", "+1 (017) 555-7713", "+12", "++49 30 1234567", "+1.2", "12 34", "1 2 3 4 5 6 7 8 9 0 1 2 3", "é", "\n", "word", "Q@Q.Q.", "@", "5.5.5.5@x.y"]
    texts = list(odd) + [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["7 " * 30000, "1." * 30000, "x@" + "a." * 30000 + "b", "w" * 100000 + "@a.b"]
    got = pii.with_base_spans(docs_of(spark, [t or "" for t in texts])).select("doc_id", "base").collect()
    for r in got:
        assert [(s.start, s.rank, s.kind, s.stop) for s in r["base"]] == brute.pii(texts[r["doc_id"]] or ""), texts[r["doc_id"]][:200]


def test_pii_disclosure(spark):
    rng = random.Random(10)
    texts = []
    for i in range(40):
        near = "Zorbulon" if i < 8 else "ordinary"
        who = "ann.lee@example.com" if i < 8 else f"user{i}@example.com"
        texts.append(f"{prose(rng, 12)} {near}, {who} {prose(rng, 12)}")
    texts += [prose(rng, 40) for _ in range(200)]
    df = docs_of(spark, texts)
    rows = {r["doc_id"]: r for r in pii.find(clashing(df)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.rank, s.kind, s.stop) for s in rows[i]["base"]] == brute.pii(t)
        extra = [t[s.start : s.stop] for s in rows[i]["extra"]]
        assert extra == (["Zorbulon"] if i < 8 else []), (i, extra)
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert "Zorbulon" not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == texts[100]
    assert pii.find(df.where("doc_id < 0")).count() == 0
    same = pii.sanitise(spark.createDataFrame([(1, None, None), (None, "a@b.c and a@b.c", "x"), (1, None, None)], "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in same if r["text"]) == [(0, "<EMAIL> and <EMAIL>")] and len(same) == 3


def test_pii_far_terms(spark):
    """A term anywhere in the documents of a value, before or after it, and the words that touch a value."""
    rng = random.Random(11)
    texts = [f"Zorbulon {prose(rng, 40)} <1.2.3.{i % 9}> ann.lee@example.com, é \uffff {prose(rng, 40)} (Zorbulon)" for i in range(12)] + [prose(rng, 40) + " é \uffff" for _ in range(400)]
    docs = docs_of(spark, texts)
    for r in pii.find(docs).collect():
        t = texts[r["doc_id"]]
        assert [t[s.start : s.stop] for s in r["extra"]] == (["Zorbulon"] * 2 if r["doc_id"] < 12 else [])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(("Zorbulon" in x) is False for x in clean.values()) and clean[20] == texts[20]


def test_pii_rare_values_and_copies(spark):
    """A value of one document is judged; copies neither hide a term nor count as documents."""
    rng = random.Random(13)
    lone = f"Quuxley {prose(rng, 30)} bob@example.com {prose(rng, 30)}"
    some = [f"{prose(rng, 20)} Zorbulon {prose(rng, 20)} ann.lee@example.com" for _ in range(4)]
    texts = [lone, *some, *[some[0]] * 300, *[prose(rng, 40) for _ in range(2500)]]
    rows = {r["doc_id"]: [texts[r["doc_id"]][s.start : s.stop] for s in r["extra"]] for r in pii.find(docs_of(spark, texts)).collect()}
    assert rows[0] == ["Quuxley"] and all(rows[i] == ["Zorbulon"] for i in range(1, 305)) and not any(rows[i] for i in range(305, len(texts)))


def test_secrets(spark, odd):
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rand = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [f"the name of_the_{a}_{b}_{i} is" for i in range(10) for a in WORDS for b in ("some", "ordinary", "number", "identifier")] + list(odd) + [prose(rng, 40) + f' TOKEN = "{hexes(40).upper()}" api-key=1 apikey: ab PassWd=\'{rand(9)}\' AKIA{rand(16).upper()} {hexes(24)} x{hexes(23)}' for _ in range(60)] + ["toKen=ſecret1 toKen=abcdef", "AKIAAKIA" + "Z" * 16]
    planted = len(texts)
    texts += [f"use {rand(32)} here", "the internationalization_configuration_of_all_things 4111111111111111111111", "some_long_ordinary_identifier_name_number_2 is fine"]
    got = {r["doc_id"]: r for r in secrets.scan(clashing(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.stop) for s in got[i]["base"]] == [(s, k, e) for s, _, k, e in brute.secrets(t or "")]
    assert [s.kind for s in got[planted]["extra"]] == ["random"] and not got[planted + 1]["extra"] and not got[planted + 2]["extra"]
    assert secrets.scan(docs_of(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_secrets_of_any_shape(spark):
    """Short random strings, letter-only ones and what stands beside a base match in one run are scored too."""
    rng = random.Random(14)
    rand = lambda n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(chars) for _ in range(n))
    letters = rand(30, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    piece = rand(24, "GHIJKLMNOPQRSTUVWXYZ") + "_"
    odd = ["use k9Qz7Lw2Xv4Tb8Rm1 here", f"use {letters} here", f"use {piece}{rand(24, '0123456789abcdef')} here"]
    texts = [prose(rng, 60) + f" secret={rand(30)} internationalization configuration 239040950064896" for _ in range(300)] + odd
    got = {r["doc_id"]: [s.value for s in r["extra"]] for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert [got[300 + i] for i in range(3)] == [["k9Qz7Lw2Xv4Tb8Rm1"], [letters], [piece]]
    assert not any(got[i] for i in range(300))


def test_quality(spark, odd):
    rng = random.Random(13)
    texts = list(odd) + [prose(rng, rng.randrange(30, 200)) for _ in range(60)] + [" ".join(w.upper() + "!!" for w in prose(rng, 100).split()) for _ in range(4)] + [(prose(rng, 9) + "\n") * 12, prose(rng, 30) + " " + prose(rng, 8) * 2]
    got = {r["doc_id"]: r for r in quality.judge(clashing(docs_of(spark, texts))).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, t in enumerate(texts):
        assert tuple(got[i][n] for n in names) == brute.quality(t or ""), i
        assert not (got[i]["base_failed"] and got[i]["kept"])
    first = len(odd)
    assert all(got[i]["kept"] for i in range(first, first + 60)) and not any(got[i]["kept"] for i in range(first + 60, first + 64))
    df = docs_of(spark, texts)
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {i for i in got if got[i]["kept"]}
    assert quality.judge(df.where("doc_id < 0")).count() == 0


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = quality.judge(docs).where("n_words >= 20").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect()
    share = dict(map(tuple, x))
    assert share[1] > 0.98 and share[0] < 0.15


def test_fingerprints(spark, odd):
    rng = random.Random(14)
    texts = [t or "" for t in odd] + [prose(rng, rng.randrange(1, 200)) for _ in range(80)]
    ids = [7 * i + (i % 5) for i in range(len(texts))]
    monkey = fingerprints.BUCKET_BYTES
    fingerprints.BUCKET_BYTES = 6000
    try:
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(clashing(docs_of(spark, [*odd, *texts[len(odd) :]], ids)).repartition(5)).collect()}
    finally:
        fingerprints.BUCKET_BYTES = monkey
    ed = brute.edited(texts)
    jac = lambda a, b: 1.0 if not (a | b) else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        r, s = got[i], brute.shingles(t)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), brute.sha(ed[k]))
        e, n = brute.shingles(ed[k]), brute.shingles(texts[(k + 1) % len(texts)])
        assert abs(r["near_edited"] - jac(s, e)) < (1e-9 if max(len(s), len(e)) <= 64 else 0.2)
        assert abs(r["near_next"] - jac(s, n)) < (1e-9 if max(len(s), len(n)) <= 64 else 0.2)
        assert r["n_distinct"] == pytest.approx(len(s), rel=0.3) if len(s) >= 128 else r["n_distinct"] == len(s)
    by = {}
    for i, t in zip(ids, texts, strict=True):
        assert by.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    one = fingerprints.fingerprints(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == brute.sha("a ba b"[:4] + "a b"[:3]) or one[0]["edited_sha256"] == brute.sha("a b " + "a b")
    assert fingerprints.fingerprints(docs_of(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_next_rows(spark, monkeypatch):
    """Every row meets the one after it, in small buckets and in large ones, with one id on a third of the rows and null on more."""
    from pyspark.sql.window import Window

    rng = random.Random(18)
    rows = [(rng.choice([None, 5, rng.randrange(-50, 50), rng.randrange(10**12)]), f"t{rng.randrange(150)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    plain = [r["text"] for r in df.withColumn("i", F.row_number().over(order)).orderBy("i").collect()]
    ids = [r["doc_id"] for r in df.orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    want = sorted(zip([(i is not None, i or 0) for i in ids], plain, [*plain[1:], plain[0]], strict=True))
    for size in (700, 3000, 1 << 24):
        monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
        got = fingerprints.with_next(df, ["text"]).collect()
        assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"], r["next_text"]) for r in got) == want, size


def test_sketches_merge(spark):
    rng = random.Random(15)
    a, b = prose(rng, 900), prose(rng, 900)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x"), "b", "y")
    sa, sb = brute.shingles(a), brute.shingles(b)
    r = df.select(fingerprints.distinct_count(fingerprints.merge(F.col("x"), F.col("y"))).alias("n"), fingerprints.containment(F.col("x"), F.col("x")).alias("c"), fingerprints.resemblance(F.col("x"), F.col("y")).alias("j")).first()
    assert r["n"] == pytest.approx(len(sa | sb), rel=0.3) and r["c"] == pytest.approx(1.0) and r["j"] == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.15)


def test_urls(spark):
    rows = [(1, "https://Sub.Example.org/es/a?x#y", ""), (2, "http://example.org/en/12", ""), (3, "https://a.org", ""), (4, "https://a.org/", None), (5, "x.com/fr/1", ""), (6, None, ""), (7, "https://k.com/fr/1", ""), (8, "https://k.com/de/1", ""), (9, "https://notorg/es/", ""),
            (10, "https://p.net/1", '<link href="https://k.com/de/1" rel="canonical">'), (11, "https://p.net/1/?q=1", ""), (12, "https://q.net/2", '<META http-equiv=refresh content="0; url=https://k.com/de/1">'), (13, "https://r.net/3", "<link rel='canonical' href='/4'>"), (14, "https://r.net/4", ""),
            (15, "https://s.net/", "<link rel=canonical href='https://k.com/fr/1'>"), (16, "https://s.net", "<link rel=canonical href='https://k.com/de/9'>"), (7, "https://k.com/fr/1", ""), (17, "", ""), (18, "://", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(clashing(df)).collect()}
    what = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert what(1) == ("sub.example.org", "/es/a", "example.org/es/", "block") and what(2) == ("example.org", "/en/12", "example.org/en/1", "block")
    assert what(3) == ("a.org", "", None, "allow") and what(4) == ("a.org", "/", "org/", "allow") and what(5) == ("", "", None, "allow") and what(6) == ("", "", None, "allow")
    assert what(7)[2:] == ("com/fr/", "allow") and what(8)[2:] == ("com/de/", "block") and what(9)[2] is None
    assert [got[i]["verdict"] for i in (10, 11, 12, 13, 14)] == ["block", "allow", "block", "allow", "allow"]
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, same_form=True).collect()}[11] == "block"
    assert [got[i]["verdict"] for i in (15, 16)] == ["allow", "allow"]  # one alias is explicitly allowed
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0
    more = spark.createDataFrame([("https://z.net/", "https://k.com/de/7"), (None, "x")], "url string, target string")
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "https://z.net/")], "page_id long, url string"), more).collect()} == {"block"}


def test_url_links(spark):
    base = "https://r.net/a/b/c.html?x"
    rows = [("<link rel=canonical href=https://k.com/de/1>", "https://k.com/de/1"), ("<meta http-equiv=refresh content=0;url=https://k.com/de/1>", "https://k.com/de/1"), ("<meta http-equiv=refresh content=\"0;url='https://k.com/de/2'\">", "https://k.com/de/2"),
            ("<link rel=canonical href='page.html'>", "https://r.net/a/b/page.html"), ("<link rel=canonical href='../x?p=1&amp;q=2'>", "https://r.net/a/x?p=1&q=2"), ("<link rel=canonical href='?y'>", "https://r.net/a/b/c.html?y"), ("<link rel=canonical href='//z.net/1'>", "https://z.net/1"), ("<link rel=canonical href='/4'>", "https://r.net/4")]
    got = urls.html_links(spark.createDataFrame([(base, h) for h, _ in rows], "url string, html string").coalesce(1)).collect()
    assert sorted(r["target"] for r in got) == sorted(t for _, t in rows)


def test_url_aliases(spark):
    """A planted set of redirects, canonical and refresh links, against union-find in plain Python."""
    rng = random.Random(17)
    n = 400
    page = lambda i: f"https://h{i}.{rng.choice(['example.org/es', 'com/fr', 'com/de', 'net/x', 'net/y', 'net/z'])}/{i}"
    all_urls = [page(i) for i in range(n)]
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(260)]
    html, moved = [""] * n, []
    for k, (a, b) in enumerate(links):
        if k % 3 == 0:
            moved.append((all_urls[a].upper().split("/")[0].lower() + "//" + all_urls[a].split("//")[1] + "#part", all_urls[b]))
        else:
            html[a] += f'<link rel="canonical" href="{all_urls[b]}">' if k % 3 == 1 else f"<meta http-equiv=Refresh content='3; URL={all_urls[b]}'>"
    top = brute.components(range(n), links)
    rule = {i: "block" if "example.org/es/" in u or ".com/de/" in u else "allow" if ".com/fr/" in u or "example.org" in u else None for i, u in enumerate(all_urls)}
    want = {}
    for i in range(n):
        group = {rule[j] for j in range(n) if top[j] == top[i]}
        want[i] = rule[i] or ("allow" if "allow" in group else "block" if "block" in group else "allow")
    got = urls.judge(spark.createDataFrame(list(zip(range(n), all_urls, html, strict=True)), "page_id long, url string, html string"), spark.createDataFrame(moved, "url string, target string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == want and sum(r["decided_by"] == "alias" for r in got) > 50
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(top[r["page_id"]])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(top.values()))


def test_broken_markup_takes_linear_time(spark):
    import time

    for bad in ("<!--", "<script>", "<script ", "<link ", "<link rel=canonical ", "<title", "<title>", "<p ", "</script ", "<", "&#", "&", '<meta content="'):
        page = bad * (1_000_000 // len(bad))
        t = time.time()
        warc.text_and_title(page)
        assert time.time() - t < 2, bad
    pages = spark.createDataFrame([(i, f"https://r.net/{i}", b * (1_000_000 // len(b))) for i, b in enumerate(("<link ", "<link rel=canonical ", "<meta http-equiv=refresh ", '<link href="', "<meta \n", "refresh<link rel  "))], "page_id long, url string, html string")
    urls.html_links(pages.limit(1)).count()
    t = time.time()
    assert urls.html_links(pages).count() == 0 and time.time() - t < 12


def test_html_text():
    read = lambda x: warc.text_and_title(x)
    assert read("<template><script>a</script>HIDDEN</template>b")[0] == "b"
    assert read("<style>x</script>y</style>z<scripty>w</scripty>") == ("zw", "")
    assert read("<TITLE>caf&#233; &eacute;&#x1F642;</TITLE ><p>1 < 2 &amp;amp; 3</p>&notin; a&nbsp;&nbsp;b") == ("café é🙂\n1 < 2 &amp; 3\n∉ a b", "café é🙂")
    assert read("a<!-- b")[0] == "a" and read("a<script>b")[0] == "a" and read("a<b c")[0] == "a" and read("") == ("", "")


def test_warc_responses(spark, tmp_path):
    """Records are cut by length: blocks that hold version lines and blank lines, packed bodies, other record types, gzip members."""
    import gzip

    def record(kind, i, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: https://a.org/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = lambda body, more="": f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1{more}\r\n\r\n".encode() + body
    bodies = ["<p>plain caf\xe9".encode("latin-1"), b"WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.0\r\n in a block\r\n\r\n", b"", b"last"]
    rows = [record("warcinfo", 0, b"x: WARC/1.0\r\n"), *[record("response", i + 1, http(b)) for i, b in enumerate(bodies)], record("request", 9, b"GET / HTTP/1.1\r\n\r\n"), record("response", 10, http(gzip.compress(b"packed"), "\r\nContent-Encoding: gzip"))]
    (tmp_path / "plain.warc").write_bytes(b"".join(rows))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows))
    (tmp_path / "short.warc").write_bytes(record("response", 20, http(b"cut off here"))[:-12])
    got = warc.read_responses(spark, str(tmp_path)).collect()
    want = [(f"<urn:{i + 1}>", b.decode("latin-1"), True) for i, b in enumerate(bodies)] + [("<urn:10>", "packed", True)]
    assert sorted((r["record_id"], r["payload"], r["intact"]) for r in got) == sorted([*want, *want, ("<urn:20>", "cut ", False)])
    assert warc.derive(warc.read_responses(spark, str(tmp_path / "plain.warc"))).where("source_content_type = 'text/html; charset=latin-1'").count() == 10


def test_warc_names(spark):
    """Extra columns of any name stay; those named like a record's field come back as source_<name>."""
    names = ["title", "status", "ctype", "bytes", "text", "meta", "mid", "cid", "r", "read", "kept", "block", "source_block", "refers_to", "source_status"]
    df = warc.responses(spark.createDataFrame([(1, "http://a/1", "<p>x")], "page_id long, url string, html string"))
    got = warc.derive(df.withColumns({c: F.lit(c) for c in names}))
    row = got.where("warc_type = 'conversion'").first().asDict()
    assert len(got.columns) == len(set(got.columns)) and row["block"] == "x" and all(row[c] == c for c in names if c not in ("block", "refers_to", "source_status"))
    assert row["_source_block"] == "block" and row["source_refers_to"] == "refers_to" and row["source_source_status"] == "source_status"


def test_warc(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><script>var x = "<p>";</script></head><body><!-- no --><p>Hi&nbsp;there<br>you &lt;3</p>\n\n<div>End</div></body></html>'
    df = spark.createDataFrame([(1, "http://a/1", html), (2, None, None), (None, "http://a/3", "")], "page_id long, url string, html string")
    found = warc.responses(df)
    rows = warc.derive(found).collect()
    assert len(rows) == 6
    conv = next(r for r in rows if r["source_id"] == 1 and r["warc_type"] == "conversion")
    meta = next(r for r in rows if r["source_id"] == 1 and r["warc_type"] == "metadata")
    resp = next(r for r in found.collect() if r["source_id"] == 1)
    assert conv["block"] == "A & B\nHi there\nyou <3\nEnd" and conv["block_digest"] == "sha256:" + brute.sha(conv["block"])
    assert conv["refers_to"] == meta["refers_to"] == resp["record_id"] and meta["concurrent_to"] == conv["record_id"] and conv["payload_digest"] == "sha256:" + brute.sha(html)
    assert conv["source_headers"] == resp["http_headers"] and conv["source_status"] == "200" and "title: A & B" in meta["block"]
    warc.write_warc(warc.derive(found), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert all(r["intact"] for r in back) and {(r["record_id"], r["block"]) for r in back} == {(r["record_id"], r["block"]) for r in rows}
    long = "<p>" + "x " * 200000 + "</p>" + "<" * 1000
    assert warc.derive(warc.responses(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string"))).count() == 2
    assert warc.derive(found.limit(0)).count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = got["toxic"] == 1, got["score"]
    auc = ((s[y].to_numpy()[:, None] > s[~y].to_numpy()[None]).mean() + 0.5 * (s[y].to_numpy()[:, None] == s[~y].to_numpy()[None]).mean())
    assert auc > 0.9 and s.between(0, 1).all() and ((s >= 0.5).astype(int) == got["predicted"]).all()
    odd_rows = clashing(spark.createDataFrame([(1, None), (None, ""), (1, None), (2, "x " * 50000)], "doc_id long, text string"))
    assert toxicity.toxicity(odd_rows, labels.limit(0)).count() == 4 and toxicity.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b])
def test_toxicity_learns_pairs(toxic):
    """Neither word alone is toxic, both together are (or only one without the other, when each alone says nothing): a linear score cannot tell."""
    import numpy as np

    rng = random.Random(16)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(WORDS, 6) + ["insult"] * a + ["people"] * b))
        y.append(float(toxic(a, b)))
    memo = {}
    ids = [toxicity.hashed_terms(t, memo) for t in texts]
    m = toxicity.fit([toxicity.counted(i) for i in ids[:2500]], np.array(y[:2500]), lift=1.0)
    assert sum((m.score(i) >= 0.5) == bool(t) for i, t in zip(ids[2500:], y[2500:], strict=True)) >= 490


def test_toxicity_score_is_the_double_sum():
    import numpy as np

    rng = random.Random(19)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(120)]
    rows = [toxicity.counted(toxicity.hashed_terms(t, {})) for t in texts]
    m = toxicity.fit(rows, np.array([float("alpha" in t) for t in texts]), steps=40)
    for t in [*texts[:40], "", "unseen words only"]:
        c = {}
        for h in toxicity.hashed_terms(t, {}).tolist():
            c[h] = c.get(h, 0) + 1
        x = {m.slot[h]: (1 + np.log(n)) * m.scale[m.slot[h]] for h, n in c.items() if m.slot[h] >= 0}
        norm = np.sqrt(sum(v * v for v in x.values())) or 1
        x = {i: v / norm for i, v in x.items()}
        z = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert m.score(toxicity.hashed_terms(t, {})) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_digest_columns(spark):
    """The digests of the registered queries follow from the operators' spans."""
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    for r in queries.op6_pii(spark, SF).collect():
        base = brute.pii(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.spans_text(base)) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(brute.spans_text(base).split(",")) <= set(r["spans"].split(",")) | {""}
    for r in queries.op7_secrets(spark, SF).collect():
        base = brute.secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.spans_text(base)) and set(brute.spans_text(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        mine = queries.queries()[name](spark, SF).toPandas()
        theirs = con.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        # nulls of whole numbers come as nan from one side and as <NA> from the other
        show = lambda x: "null" if str(x) in ("None", "nan", "<NA>") else str(round(float(x), 6)) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)
        rows = lambda df: sorted(json.dumps([show(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
        assert rows(mine) == rows(theirs), name
    assert re

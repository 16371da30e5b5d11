"""Exact set-similarity join on word shingles, with set-relation skipping.

Two texts link when the Jaccard similarity of their shingle sets reaches threshold. The answer is whole: the prefix
filter never loses a link, candidates are verified on complete sets, and equal sets are one node.

Method:

* Each set is ordered rare shingles first, by counts over all documents in hash buckets (any common order is correct;
  this one keeps frequent passages out of the indexed part). Sharing a link means sharing a shingle of the first
  n - ceil(threshold n) + 1, so only those are indexed.
* An inverted list is kept sorted by set size and position and cut in blocks. A block states its sizes and its least
  position; pairs of blocks that cannot hold a link by size or by position are skipped whole.
* Highly similar sets are found first by min-hash bands and compared with the smallest id of their band, their head.
  Sets known to be connected are never paired, and a list whose sets are all connected already is skipped whole. So a
  group of n near copies costs about n checks, not n squared.
* Candidates must share as many indexed shingles as a link implies. Of those left, heads are compared, and the answers of
  the sets near them are derived from the heads' answers by bounds; complete sets are compared only where these leave it
  open (see derived()).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each_set, mix
from .components import components

SKETCH_BITS = 16  # buckets of the shingle counts: a table of fixed size
BANDS, ROWS = 4, 3
WANTED_BITS = 20  # buckets of the filter of wanted ids: a table of fixed size
BLOCK = 512
SHORT = 16  # entries of lists that are paired together
HOT = 128  # pairs of one id that one task takes
BLOCKS = 8  # blocks of one token that one task compares with the others

_PROFILE = "doc_id long, n int, k1 long, k2 long, bands array<long>, bucket int, hits long"


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(_signed([mix(s, salt).sum(dtype=np.uint64)])[0]) for salt in (0x5BD1E995, 0x1B873593))


def _profile(size: int):
    """Rows of each document (set size, key, bands) and, at the end of a task, its shingle counts by bucket."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bucket", pa.int32()), ("hits", pa.int64())])
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B9)) | np.uint64(1)
        for batch in batches:
            ns, k1s, k2s, bands, buckets = [], [], [], [], []
            for _, s in each_set(batch.column("text"), size):
                key = _key(s)
                ns.append(len(s))
                k1s.append(key[0])
                k2s.append(key[1])
                if len(s):
                    with np.errstate(over="ignore"):
                        low = np.multiply.outer(salts, s).min(axis=1).reshape(BANDS, ROWS)
                        bands.append(_signed(mix((low * salts[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))))
                    if key not in seen:
                        seen.add(key)
                        buckets.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                else:
                    bands.append(None)
            if buckets:
                counts += np.bincount(np.concatenate(buckets), minlength=len(counts))
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int32()), pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(bands, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], schema=schema)

    return run


def _prefix_rows(size: int, num: int, den: int, heat):
    """(token, k1, shape) of the indexed part of each set that is new in its task; shape is n * 2**32 + position."""

    def run(batches):
        import pyarrow as pa

        count, seen = heat.value, set()
        for batch in batches:
            tokens, keys, shapes, got = [], [], [], 0
            for _, s in each_set(batch.column("text"), size):
                n = len(s)
                if not n or (key := _key(s)) in seen:
                    continue
                seen.add(key)
                p = n - -(-num * n // den) + 1
                order = np.argsort(count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:p]
                tokens.append(_signed(s[order]))
                keys.append(np.full(p, key[0], np.int64))
                shapes.append((n << 32) + np.arange(p, dtype=np.int64))
                got += p
                if got > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, shapes)], names=["token", "k1", "shape"])
                    tokens, keys, shapes, got = [], [], [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, shapes)], names=["token", "k1", "shape"])

    return run


def _shared(batches):
    """Of rows sorted by token, shape, k1: those of tokens that at least two different sets have, each once."""
    import pyarrow as pa

    last, told, known = None, False, False  # the last row; whether it was let through; whether its token is shared
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if last is not None:
            cols = [np.concatenate(([x], c)) for x, c in zip(last, cols, strict=True)]
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[np.concatenate(([True], new))] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        shared = np.concatenate(([known], same)) | np.concatenate((same, [False]))
        out = shared.copy()
        out[0] &= not told
        told = bool(shared[-1])
        known, last = told, [c[-1] for c in cols]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols], names=["token", "k1", "shape"])


def _need(na, nb, num: int, den: int):
    """Least intersection of a link between sets of these sizes."""
    return -(-(num * (na + nb)) // (num + den))


_PAIR = "a long, na int, b long, nb int"
_LISTS = f"{_PAIR}, token long, no int, lo int, hi int, plo int, phi int, clo long, chi long, node array<long>, comp array<long>, shape array<long>"


def _pairs_of(x, y, num: int, den: int):
    """Pairs of entries (node, comp, shape arrays) of one list that may link, of different components."""
    (xi, xc, xs), (yi, yc, ys) = x, y
    xn, xp, yn, yp = xs >> 32, xs & 0xFFFFFFFF, ys >> 32, ys & 0xFFFFFFFF
    small, large = np.minimum(xn[:, None], yn[None]), np.maximum(xn[:, None], yn[None])
    ok = (xc[:, None] != yc[None]) & (den * small >= num * large)
    rest = 1 + np.minimum((xn - xp - 1)[:, None], (yn - yp - 1)[None])
    ok &= rest + np.minimum(xp[:, None], yp[None]) >= _need(small, large, num, den)
    i, j = np.nonzero(ok)
    return np.minimum(xi[i], yi[j]), np.maximum(xi[i], yi[j]), np.where(xi[i] < yi[j], xn[i], yn[j]), np.where(xi[i] < yi[j], yn[j], xn[i])


def _short_pairs(of, e, num: int, den: int) -> np.ndarray:
    """_pairs_of() of many lists at once, none longer than SHORT: rows (a, b, na, nb) of the entries e, of being their lists' numbers in order."""
    node, comp, shape = e
    out = []
    for d in range(1, SHORT):
        i = np.flatnonzero(of[d:] == of[:-d])
        if not len(i):
            break
        j = i + d
        n, m, p, q = shape[i] >> 32, shape[j] >> 32, shape[i] & 0xFFFFFFFF, shape[j] & 0xFFFFFFFF
        ok = (comp[i] != comp[j]) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
        ok &= 1 + np.minimum(n - p - 1, m - q - 1) + np.minimum(p, q) >= _need(n, m, num, den)
        i, j, n, m = i[ok], j[ok], n[ok], m[ok]
        turn = node[i] > node[j]
        out.append(np.stack([np.where(turn, node[j], node[i]), np.where(turn, node[i], node[j]), np.where(turn, m, n), np.where(turn, n, m)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _unique_pairs(a, b, na, nb):
    return np.unique(np.stack([a, b, na, nb], 1), axis=0)


def _pair_frame(rows: list[np.ndarray]):
    import pandas as pd

    x = np.concatenate(rows)
    return pd.DataFrame({"a": x[:, 0], "na": x[:, 2].astype(np.int32), "b": x[:, 1], "nb": x[:, 3].astype(np.int32)})


def _lists(num: int, den: int):
    """Of rows (token, node, comp, shape) sorted by token and shape: the pairs of each list of one block; of a longer list, its blocks."""

    def run(batches):
        import pandas as pd

        blank = ["token", "no", "lo", "hi", "plo", "phi", "clo", "chi", "node", "comp", "shape"]

        def block(no):
            e = [x[:BLOCK] for x in left]
            n, p = e[2] >> 32, e[2] & 0xFFFFFFFF
            blocks.append((token, no, n.min(), n.max(), p.min(), p.max(), e[1].min(), e[1].max(), *e))

        def close():
            if no:
                block(no + 1)
            elif len(left[0]) > 1 and (left[1] != left[1][0]).any() and len((found := _pairs_of(left, left, num, den))[0]):
                pairs.append(_unique_pairs(*found))

        def out():
            if pairs:
                yield _pair_frame(pairs).assign(**dict.fromkeys(blank))
            if blocks:
                yield pd.DataFrame(blocks, columns=blank).assign(a=None, na=None, b=None, nb=None)
            pairs.clear()
            blocks.clear()

        names = [c.split()[0] for c in _LISTS.split(", ")]
        empty = [np.zeros(0, np.int64)] * 3
        token, no, left, pairs, blocks = None, 0, empty, [], []
        for pdf in batches:
            t = pdf["token"].to_numpy()
            cols = [pdf[c].to_numpy() for c in ("node", "comp", "shape")]
            cuts = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
            sizes = np.diff(cuts)
            # short lists that lie in this batch as a whole are paired together; the first and the last may go on in another
            whole = sizes <= SHORT
            whole[[0, -1]] = False
            if whole.any():
                at = np.repeat(whole, sizes)
                found = _short_pairs(np.repeat(np.arange(len(sizes)), sizes)[at], [c[at] for c in cols], num, den)
                if len(found):
                    pairs.append(found)
            for lo, hi in zip(cuts[:-1][~whole].tolist(), cuts[1:][~whole].tolist(), strict=True):
                if lo == hi:
                    continue
                if t[lo] != token:
                    if token is not None:
                        close()
                    token, no, left = t[lo], 0, empty
                left = [np.concatenate((x, c[lo:hi])) for x, c in zip(left, cols, strict=True)]
                while len(left[0]) > BLOCK:
                    no += 1
                    block(no)
                    left = [x[BLOCK:] for x in left]
            for x in out():
                yield x[names]
        if token is not None:
            close()
        for x in out():
            yield x[names]

    return run


def _block_pairs(num: int, den: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                found = _pairs_of((r.node, r.comp, r.shape), (r.node2, r.comp2, r.shape2), num, den)
                if len(found[0]):
                    yield _pair_frame([_unique_pairs(*found)])

    return run


def _sets(size: int, wanted):
    def run(batches):
        import pyarrow as pa

        flags = wanted.value
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            x = ids.fill_null(0).to_numpy(zero_copy_only=False)
            hit = flags[(mix(x.view(np.uint64)) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)] & ids.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(hit)
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                found = [_signed(s) for _, s in each_set(batch.column("text").take(pa.array(part)), size)]
                yield pa.RecordBatch.from_arrays([pa.array(x[part]), pa.array(found, pa.list_(pa.int64()))], names=["id", "items"])

    return run


def _wanted(ids: DataFrame):
    """A table of 2**WANTED_BITS flags that holds for every id; others may hold as well and are dropped by the join."""
    spark = ids.sparkSession

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x = pdf["id"].to_numpy().astype(np.int64).view(np.uint64)
            yield pd.DataFrame({"at": np.unique((mix(x) >> np.uint64(64 - WANTED_BITS)).astype(np.int32))})

    flags = np.zeros(1 << WANTED_BITS, bool)
    flags[[r[0] for r in ids.mapInPandas(run, "at int").distinct().collect()]] = True  # at most 2**WANTED_BITS small rows
    return spark.sparkContext.broadcast(flags)


def sets_of(docs: DataFrame, ids: DataFrame, scratch: Scratch, size: int, name: str) -> DataFrame:
    """(id, items, parts), written: the whole sets of ids(id, n), where n pairs hold the id. An id of many pairs is dealt to parts."""
    sets = docs.select("doc_id", "text").mapInArrow(_sets(size, _wanted(ids)), "id long, items array<long>")
    return scratch.keep(sets.join(ids.select("id", F.expr(f"cast(1 + n div {HOT} as int)").alias("parts")), "id"), name)


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, c) of pairs(a, b) of ids: sizes of their sets, and of what both hold. The pairs of a hot id, and its set, are dealt to its parts."""
    hot = sets.where("parts > 1").select("id", "parts").distinct()
    part = lambda other, parts: F.pmod(F.xxhash64(other), F.coalesce(parts, F.lit(1))).cast("int")
    for x, other in (("a", "b"), ("b", "a")):
        pairs = pairs.join(hot.select(F.col("id").alias(x), F.col("parts").alias(f"{x}_parts")), x, "left").withColumn(f"{x}_part", part(other, F.col(f"{x}_parts"))).drop(f"{x}_parts")
    each = sets.select("id", "items", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    for x in ("a", "b"):
        pairs = pairs.join(each.select(F.col("id").alias(x), F.col("part").alias(f"{x}_part"), F.col("items").alias(f"{x}_items")), [x, f"{x}_part"])
    # an id that several rows bear has several sets: of them the most similar pair
    both = pairs.select("a", "b", F.size("a_items").alias("na"), F.size("b_items").alias("nb"), F.size(F.array_intersect("a_items", "b_items")).alias("c"))
    return both.groupBy("a", "b").agg(F.max_by(F.struct("na", "nb", "c"), F.struct(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), "c")).alias("m")).select("a", "b", "m.*")


def _ids(pairs: DataFrame) -> DataFrame:
    """(id, n) of the ids in pairs(a, b), and how many pairs hold each."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def _linked(num: int, den: int) -> Column:
    return F.expr(f"{den} * c >= {num} * (na + nb - c)")


def derived(docs: DataFrame, pairs: DataFrame, near: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what pairs(a, na, b, nb) would join if each were verified.

    near(id, head, n_head, c): a set, the highly similar set it was compared with, that one's size, what both hold.
    The answers of heads are computed; those of the sets near them follow: of head sets that share c elements, sets that
    lack x and y of their heads' elements share c - x - y at least, and sets that hold u and v other elements share
    c + u + v at most. Where the heads link, their components are joined and nothing is left to ask. Only pairs that
    these bounds leave open are verified on their own sets.
    """
    met = pairs
    for x in ("a", "b"):
        met = met.join(near.select(F.col("id").alias(x), F.col("head").alias(f"h{x}"), F.col("n_head").alias(f"nh{x}"), F.col("c").alias(f"c{x}")), x, "left")
        met = met.withColumns({f"h{x}": F.coalesce(f"h{x}", x), f"nh{x}": F.coalesce(f"nh{x}", f"n{x}"), f"c{x}": F.coalesce(f"c{x}", f"n{x}")})
    met = scratch.keep(met, "met")
    heads = met.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).where("a < b").distinct()
    heads = scratch.keep(intersections(heads, sets_of(docs, _ids(heads), scratch, size, "head_sets")), "heads")
    known = heads.select("a", "b", F.col("c").alias("ch"), _linked(num, den).alias("joined"))
    met = met.withColumns({"l": F.least("ha", "hb"), "r": F.greatest("ha", "hb")}).join(known.withColumnsRenamed({"a": "l", "b": "r"}), ["l", "r"])
    need = f"({num} * (na + nb) + {num + den - 1}) div {num + den}"
    met = met.where("NOT joined").withColumn("sure", F.expr(f"ch - (nha - ca) - (nhb - cb) >= {need}")).withColumn("open", F.expr(f"least(na, nb, ch + (na - ca) + (nb - cb)) >= {need}"))
    met = scratch.keep(met.where("sure OR open").select("a", "b", "sure"), "left")
    found = known.where("joined").select("a", "b").unionByName(met.where("sure").select("a", "b"))
    left = met.where("NOT sure").select("a", "b")
    if not left.isEmpty():
        found = found.unionByName(intersections(left, sets_of(docs, _ids(left), scratch, size, "sets")).where(_linked(num, den)).select("a", "b"))
    return found.distinct()


def jaccard_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text, ...): see the module's text. threshold is a fraction.

    component_id is the smallest doc_id reachable by links, itself included. Null or blank texts have an empty set and
    link with nothing. Rows with the same doc_id are one node and stay separate rows. A row without doc_id stays, with
    its size, links with nothing and has a null component_id. Very long texts are whole sets. Other columns are ignored. An empty table gives no rows.
    """
    spark, (num, den) = docs.sparkSession, threshold
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch.keep(docs.mapInArrow(_profile(size), _PROFILE), "profile")
    heat = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in profile.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits")).collect():  # 2**SKETCH_BITS rows at most
        heat[r[0]] = r[1]
    rows = profile.where("n IS NOT NULL")
    reps = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = scratch.keep(reps, "reps")

    # highly similar sets first: each against the smallest id of its band
    bands = reps.select("rep", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("band", "a")
    close = bands.join(heads, "band").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    close = scratch.keep(close, "close")
    # ids that several different sets bear are one node: link their sets' representatives
    twice = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("p"), F.max(F.struct("k1", "k2")).alias("q")).where("p <> q").select("doc_id")
    twice = rows.where("n > 0").join(twice, "doc_id", "left_semi").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    close = scratch.keep(intersections(close, sets_of(docs, _ids(close), scratch, size, "close_sets")).where(_linked(num, den)), "compared")
    links = scratch.keep(close.select("a", "b").unionByName(twice), "links")
    near = close.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct(F.col("a").alias("head"), F.col("na").alias("n_head"), "c"), F.struct("a", "c")).alias("m")).select("id", "m.*")
    # of ids with several sets nothing can be derived: bounds that leave all open
    many = scratch.keep(twice.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "many")
    near = near.join(many, "id", "left_anti").join(many.withColumnRenamed("id", "head"), "head", "left_anti").select("id", "head", F.col("n_head").cast("long").alias("n_head"), F.col("c").cast("long").alias("c"))
    near = scratch.keep(near.unionByName(many.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("n_head"), F.lit(-(2**40)).cast("long").alias("c"))), "near_heads")
    known = scratch.keep(components(links, scratch, "near"), "known")

    # the index, of all sets
    cached = spark.sparkContext.broadcast(heat)
    index = docs.select("text").mapInArrow(_prefix_rows(size, num, den, cached), "token long, k1 long, shape long")
    index = index.repartition("token").sortWithinPartitions("token", "shape", "k1").mapInArrow(_shared, "token long, k1 long, shape long")
    nodes = reps.join(known, reps.rep == known.node, "left").select("k1", F.col("rep").alias("node"), F.coalesce("component", "rep").alias("comp"))
    index = index.join(nodes, "k1").select("token", "node", "comp", "shape")
    index = index.repartition("token").sortWithinPartitions("token", "shape", "node")
    lists = scratch.keep(index.mapInPandas(_lists(num, den), _LISTS), "lists")
    blocks = lists.where("no IS NOT NULL").drop("a", "na", "b", "nb")
    # a token of many blocks is dealt to parts: each takes some of its blocks, and meets all
    mixed = blocks.groupBy("token").agg(F.min("clo").alias("x"), F.max("chi").alias("y"), F.count("*").alias("n")).where("x < y").select("token", F.expr(f"cast(1 + n div {BLOCKS} as int)").alias("parts"))
    other = blocks.join(mixed, "token").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", "part", *[F.col(c).alias(f"{c}2") for c in blocks.columns if c != "token"])
    blocks = blocks.join(mixed, "token").withColumn("part", F.pmod("no", "parts").cast("int")).drop("parts")
    met = blocks.join(other, ["token", "part"]).where(f"""
        no <= no2 AND {den} * hi >= {num} * lo2 AND {den} * hi2 >= {num} * lo
        AND (greatest(hi, hi2) - greatest(0, plo2 - phi, plo - phi2)) * {num + den} >= {num} * (lo + lo2)
        AND NOT (clo = chi AND clo2 = chi2 AND clo = clo2)""")
    met = met.select("node", "comp", "shape", "node2", "comp2", "shape2").mapInPandas(_block_pairs(num, den), _PAIR)
    pairs = lists.where("a IS NOT NULL").select("a", "na", "b", "nb").unionByName(met)
    past = lambda n: f"(({num} * {n} + {den - 1}) div {den} - 1)"  # noqa: E731  shingles outside the indexed part
    least = f"({num} * (na + nb) + {num + den - 1}) div {num + den} - greatest({past('na')}, {past('nb')})"
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(f"c >= {least}").select("a", "na", "b", "nb")
    pairs = scratch.keep(pairs, "pairs")
    more = scratch.keep(derived(docs, pairs, near, scratch, size, num, den), "more")
    # components of components
    label = lambda c: F.coalesce(F.col(f"c_{c}"), F.col(c)).alias(c)
    for c in ("a", "b"):
        more = more.join(known.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), c, "left").select(label(c), *(x for x in ("a", "b") if x != c))
    final = scratch.keep(components(more, scratch, "all"), "final").select(F.col("node").alias("comp"), F.col("component").alias("top"))
    of = nodes_of(reps, known).join(final, "comp", "left").select("k1", "k2", F.coalesce("top", "comp").alias("component_id"))
    of = scratch.keep(of, "of")
    scratch.drop("close", "compared", "many", "close_sets", "near_heads", "links", "lists", "pairs", "met", "head_sets", "sets", "heads", "left", "more")
    out = rows.join(of, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.cast("long").alias("component_id"))


def nodes_of(reps: DataFrame, known: DataFrame) -> DataFrame:
    return reps.join(known, reps.rep == known.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("comp"))


def keep_first(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id. Rows without doc_id stay; of repeated rows with one doc_id, all stay or go together."""
    found = jaccard_components(docs, size, threshold)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")



"""Bottom-k sketches of shingle hashes as document fingerprints, with DataFrame functions only.

A sketch is the sorted array of the k least distinct shingle hashes of a text. Sketches of parts merge into the sketch
of the whole, and estimate resemblance, containment and the number of distinct shingles. With k or fewer shingles, all
of these are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lower_ascii, once, text_of, words_of

K = 128
SIZE = 5
COARSE = 64  # quantiles of doc_id; between two of them ids are dealt evenly
BUCKET_BYTES = 16 << 20  # of text in a bucket, about; a task takes one or a few buckets


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SIZE) -> DataFrame:
    """df with the sketch of column text (null: empty) as out: array<long>, empty without words."""
    w, h = f"_{out}_w", f"_{out}_h"
    df = df.withColumn(w, once(words_of(lower_ascii(text_of(text)))))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
    df = df.withColumn(h, once(F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))))
    return df.withColumn(out, once(F.slice(F.sort_array(F.array_distinct(h)), 1, k))).drop(w, h)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the texts of two sketches together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike (1)."""
    u = merge(a, b, k)
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, -1).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**64) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained (1)."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def _order() -> list[Column]:
    """Ascending doc_id, nulls first; rows of one id by a hash of their text, so that they can be dealt to buckets in order."""
    return [F.col("doc_id").asc_nulls_first(), F.col("_h").asc(), F.col("text").asc()]


def _bucket_of(docs: DataFrame) -> tuple[Column, int]:
    """A bucket number that does not decrease in _order(), and the number of buckets.

    Ids are cut at quantiles and each part between two of them evenly, as finely as its bytes ask. An id that fills two
    quantiles, and null, are parts of their own, cut by the hash of the text: no id makes a bucket grow.
    """
    size = F.sum(F.octet_length("text").cast("long") + 64)
    seen = docs.agg(size.alias("bytes"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text").cast("long") + 64)).alias("unnamed"), F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 1000).alias("q"), F.max("doc_id").alias("hi")).first()
    q = list(seen["q"] or [])
    cut = lambda share: max(1, -(-int(share) // BUCKET_BYTES))  # noqa: E731  buckets for so many bytes
    by_hash = lambda n: F.least(F.lit(n - 1), F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * n)).cast("long")
    parts = cut(seen["unnamed"] or 0)
    at, n = by_hash(parts), parts
    each = ((seen["bytes"] or 0) - (seen["unnamed"] or 0)) / COARSE
    if q:
        edges = sorted({*q, seen["hi"] + 1})
        hot = {e for e in edges if q.count(e) > 1}
        edges = sorted({*edges, *(e + 1 for e in hot)})
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            parts = cut(each * max(1, q.count(lo)))
            place = by_hash(parts) if lo in hot else F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - F.lit(lo)).cast("double") / (hi - lo) * parts)).cast("long")
            # below the least quantile there may be ids as well: they belong to the first part
            at = F.when(F.col("doc_id") >= lo, F.lit(n) + F.greatest(F.lit(0).cast("long"), place)).otherwise(at) if lo != edges[0] else F.when(F.col("doc_id").isNotNull(), F.lit(n) + F.greatest(F.lit(0).cast("long"), place)).otherwise(at)
            n += parts
    return at.cast("long"), n


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the given columns of the next row in _order(), as next_<column>; after the last comes the first.

    Rows are dealt to buckets that follow each other. Each bucket also gets, as a guest, the first row of the bucket
    after it (the last: of the first one), so one shuffle is enough and no row waits for another bucket. The number of
    buckets and of tasks grows with the bytes of text.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.withColumn("_h", F.xxhash64("text"))
    bucket, n = _bucket_of(docs)
    docs = docs.withColumn("_b", bucket)
    heads = docs.groupBy("_b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "_h")).alias("m")).select("_b", F.col("m.doc_id").alias("head"), F.col("m._h").alias("head_h"))
    before = F.lag("_b").over(Window.orderBy("_b"))
    last = F.max("_b").over(Window.partitionBy())
    heads = scratch.keep(heads.select(F.col("_b").alias("hb"), "head", "head_h", F.coalesce(before, last).alias("to")), "heads")  # one row a bucket
    met = docs.join(heads, (F.col("_b") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("_h") == F.col("head_h")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("to").alias("b"), F.lit(1).alias("guest"))
    met = met.withColumn("_at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select(*docs.columns, "_at.*")
    # two copies of a bucket's first row are two guests, of which the first is met; they are equal
    out = met.repartition(n, "b").withColumn("_n", F.lead(F.struct(*columns)).over(Window.partitionBy("b").orderBy("guest", *_order()))).where("guest = 0")
    return out.select(*[c for c in docs.columns if c not in ("_b", "_h")], *[F.col("_n")[c].alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, in_edited) of docs(doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Null texts are empty; empty texts have the empty fingerprint, alike (1.0) to another empty one. Of rows
    with equal doc_id the order is by a hash of the text, then by text; rows without doc_id come first. Very long texts are read whole. A single document is its own next. An empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    docs = with_next(with_sketch(docs, "text", "fp", k, size), ["text", "fp"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("edited", once(F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", "edited")
    docs = with_sketch(docs, "edited", "efp", k, size)
    a, b = F.col("fp"), F.col("efp")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), to_text(a).alias("fingerprint"), to_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).cast("double").alias("near_edited"), resemblance(a, F.col("next_fp"), k).cast("double").alias("near_next"),
        distinct_count(a, k).alias("n_distinct"), containment(a, b, k).alias("in_edited"),
    )

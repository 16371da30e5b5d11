"""Quality rules: repetition and length counts, and divergence of a document's histograms from its language's reference.

DataFrame functions only. The common words are those of all documents of a language, the references sums over its documents that pass the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, once, quoted, text_of, words_of

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30  # base rules: words at least; percent of words in repeated windows at most
SYMBOLS = "#*$%&|<>"
#: Character classes; letters beyond ASCII and all other characters are two classes more.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r", ".,;:'\"?-()", "!", SYMBOLS + "=+^~_\\/{}[]@`"]
N_COMMON = 12  # words of a language's common-word histogram
#: Guards: fewer words than these are not judged by the histogram.
MIN_FOR_CLASSES, MIN_FOR_WORDS = 40, 40
#: Jensen-Shannon distances (0 to 1) beyond which a document is rejected; chosen on labelled documents, see README.
MAX_CLASSES, MAX_WORDS = 0.24, 0.38


def _count(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs' doc_id, lang and base counts, classes (characters of each class) and low (lower-cased words); with whole, also row, a struct of all columns."""
    row = [F.struct(*map(quoted, docs.columns)).alias("row")] if whole else []
    df = docs.select(*row, "doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("t"), F.xxhash64(text_of()).alias("text_hash"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # what is frequent goes first, so that the other classes are counted in what little is left
    df = df.withColumns({"w": once(words_of(F.col("t"))), "lines": once(lines), "t1": once(F.regexp_replace("t", "[a-z]+", ""))})
    df = df.withColumn("t2", once(F.regexp_replace("t1", r"[\x20\x09-\x0D]+", "")))
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    df = df.withColumn("h", once(F.when(F.size("w") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))))
    lower, space = F.length("t") - F.length("t1"), F.length("t1") - F.length("t2")
    counts = [lower, *[_count(F.col("t2"), c) for c in CLASSES[1:3]], space, *[_count(F.col("t2"), c) for c in CLASSES[4:]]]
    wide = F.length(F.regexp_replace("t2", r"[\x00-\x7F]+", ""))
    row = ["row"] if whole else []
    df = df.select(
        *row, "doc_id", "lang", "text_hash", "w", F.size("w").cast("long").alias("n_words"), (F.length("t") - space).cast("long").alias("word_chars"), _count(F.col("t2"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", (F.size("h") > F.size(F.array_distinct("h"))).alias("again"), F.array(*counts, wide).alias("c"), F.length("t").alias("n"),
    )
    # windows that occur twice or more stand next to each other once sorted; words under them are counted once
    order = F.when(F.col("again"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("s", once(order))
    near = lambda x, j: (F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("p", once(F.sort_array(F.transform(F.filter("s", near), lambda x: x["i"]))))
    gaps = F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW))))
    repeated = F.when(F.col("again"), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0), F.col("n") - F.aggregate("c", F.lit(0), lambda a, x: a + x))
    df = df.select(*row, "doc_id", "lang", "text_hash", "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", once(repeated).alias("n_repeat_words"), F.concat("c", F.array(rest)).alias("classes"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("low", once(F.transform("w", lambda x: F.lower(x)))).drop("w")


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, common): the N_COMMON most frequent lower-cased words of all documents of a language, ties by word. Counts are combined before the shuffle."""
    words = docs.select(F.col("lang").cast("string").alias("lang"), F.explode_outer(F.split(F.lower(text_of()), r"[\x20\x09-\x0D]+")).alias("word"))
    n = words.groupBy("lang", "word").agg(F.count("*").alias("n")).where("word <> ''")
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= N_COMMON)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of one length (counts or shares); 0 if one of them is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = lambda a: F.transform(a, lambda x: x.cast("double") / F.greatest(total(a), F.lit(1e-300)))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    d = F.aggregate(F.zip_with(share(p), share(q), lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(d, F.lit(0.0)))).otherwise(F.lit(0.0))


def _sums(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(name)[i]) for i in range(n)])


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): the base counts, base_failed, class_distance, word_distance, kept.

    kept is false if a base rule fails, or if the document has MIN_FOR_CLASSES words and its character classes lie
    farther than MAX_CLASSES from the language's, or MIN_FOR_WORDS words and its common words farther than MAX_WORDS.
    A null lang is a language of its own; a language none of whose documents passes the base rules has no reference,
    and its documents are judged by the base rules alone. Null texts have no words and fail. Very long texts are counted whole. Repeated rows stay. An
    empty table gives no rows. Other columns are ignored.
    """
    return _judged(docs, False)


def _judged(docs: DataFrame, whole: bool) -> DataFrame:
    scratch, row = Scratch(docs.sparkSession), ["row"] if whole else []
    feats = features(docs, whole)
    common = scratch.keep(common_words(docs), "common")
    hit = feats.join(common.withColumnRenamed("lang", "l"), F.expr("lang <=> l"), "left")
    hit = hit.withColumn("found", once(F.filter("low", lambda x: F.array_contains("common", x))))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lang", "text_hash", "classes"]
    # one expression a word: a lambda over common would evaluate what stands behind found again for each word
    per = [F.coalesce(F.size("found") - F.size(F.array_remove("found", F.get("common", F.lit(i)))), F.lit(0)) for i in range(N_COMMON)]
    rows = hit.select(*row, *base, F.array(*per, (F.col("n_words") - F.greatest(F.size("found"), F.lit(0))).cast("int")).alias("counts"))
    rows = scratch.keep(rows, "rows")
    sums = rows.where("NOT base_failed").groupBy("lang").agg(_sums("classes", len(CLASSES) + 2).alias("class_ref"), _sums("counts", N_COMMON + 1).alias("word_ref"))
    sums = scratch.keep(sums.withColumnRenamed("lang", "l"), "sums")
    out = rows.join(sums, F.expr("lang <=> l"), "left").withColumns({"a": js_distance(F.col("classes"), F.col("class_ref")), "b": js_distance(F.col("counts"), F.col("word_ref"))})
    far = (F.col("n_words") >= MIN_FOR_CLASSES) & (F.coalesce("a", F.lit(0.0)) > MAX_CLASSES) | (F.col("n_words") >= MIN_FOR_WORDS) & (F.coalesce("b", F.lit(0.0)) > MAX_WORDS)
    return out.select(*row, *base[:7], (~F.col("base_failed") & ~far).alias("kept"), F.col("a").alias("class_distance"), F.col("b").alias("word_distance"), "lang", "text_hash")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are. The rows go along with their counts, so that texts are not shuffled to meet their verdicts."""
    return _judged(docs, True).where("kept").select("row.*")

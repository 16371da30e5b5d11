"""Personal data: base patterns, and terms that corpus co-occurrence shows to reveal a protected value. DataFrame functions only.

Disclosure of value e by term t is PMI(e; t) / IC(e): 1 when t stands in no document without e, 0 when they are
independent. IC(e) = -ln p(e). All counts are of distinct texts of the whole corpus, so that copies count once; joint
counts are of those that hold both, at any distance. With p(e | t) in place of counts, PMI is ln(p(e | t) / p(e)); of
p(e | t) the lower end of its Wilson interval is taken, so that few texts show less and no value is left unjudged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, once, text_of, words_of

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, with possessive repeats (same matches, no backtracking and no recursion on long texts).
#: A match starts at the start of its run of characters or where the one before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its kind to be looked for at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9][\x200-9-]{11}", "phone": r"\+[0-9]"}
MASK = "\uffff"  # stands for the code points of values; no character
Z = 1.645  # standard deviations down from the share of a term's texts that hold a value: its lower bound at 95 %
SALTS = 8  # parts that the copies of one text are dealt to
GENERALISE, REMOVE = 0.8, 0.95  # disclosure from which a term is generalised, removed
SPANS = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"


def _pieces(t: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))


def _located(hits: Column, pieces: Column) -> Column:
    """array<struct(start, value)> of hits that stand between pieces, by one pass over their lengths."""
    none = F.array().cast("array<struct<start:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        return F.struct((start + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["h"].alias("value")))).alias("out"))

    both = F.zip_with(hits, F.slice(pieces, 1, F.greatest(F.size(hits), F.lit(0))), lambda h, p: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(both, zero, step, lambda acc: acc["out"])


def _digits(v: Column) -> Column:
    return F.translate(v, "+ ().-", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(v)).between(12, 19) & _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _spans(kind: str, rank: int, located: Column) -> Column:
    good = F.filter(located, lambda x: _valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value")))


def with_base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """df with out: the base spans of column text (no nulls), sorted by start, then kind as listed; code points, end exclusive."""
    for rank, kind in enumerate(KINDS):
        p, h, s = (f"_pii_{kind}_{x}" for x in "phs")
        pieces, hits = _pieces(F.col(text), PATTERNS[kind])
        there = F.col(text).rlike(HINTS[kind])
        df = df.withColumn(h, once(F.when(there, hits))).withColumn(p, once(F.when(F.size(h) > 0, pieces)))
        spans = _spans(kind, rank, _located(F.col(h), F.col(p)))
        df = df.withColumn(s, once(F.when(F.size(h) > 0, spans))).drop(p, h)
    none = F.array().cast(SPANS)
    parts = [f"_pii_{k}_s" for k in KINDS]
    return df.withColumn(out, once(F.sort_array(F.concat(*[F.coalesce(F.col(c), none) for c in parts])))).drop(*parts)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, base, held) of docs(doc_id, text): the base spans, and the text, without its values, of a row that has some."""
    df = with_base_spans(docs.select("doc_id", row_key().alias("row"), text_key().alias("key"), text_of().alias("text")))
    return df.select("doc_id", "row", "key", "base", F.when(F.size("base") > 0, _masked(F.col("text"), F.col("base"))).alias("held"))


def _plain(text: Column) -> Column:
    """text without MASK, at the same length."""
    return F.replace(text, F.lit(MASK), F.lit("\ufffe"))


def _masked(text: Column, base: Column) -> Column:
    """text with MASK for each code point of its base spans."""
    plain, none = _plain(text), F.array().cast("array<string>")

    def step(acc, x):
        start = F.greatest(acc["at"], x["start"])
        add = F.when(x["stop"] > acc["at"], F.array(F.substr(plain, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(MASK), x["stop"] - start))).otherwise(none)
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    return F.aggregate(base, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(plain, acc["at"] + 1, F.length(plain))))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\p{Punct}]+|[\p{Punct}]+$", "")


def _term(c: Column) -> Column:
    return F.lower(_bare(c))


def places(texts: DataFrame) -> DataFrame:
    """(key, start, stop, value, term) of each word of texts(key, held); words that touch a base span are no terms."""
    pieces, hits = _pieces(F.col("held"), WORD)
    df = texts.withColumns({"_h": once(hits), "_p": once(pieces)})
    df = df.select("key", F.posexplode(F.arrays_zip(F.slice("_p", 1, F.size("_h")).alias("p"), F.col("_h").alias("h"))).alias("i", "x"))
    df = df.select("key", "i", F.col("x.h").alias("h"), F.length("x.p").alias("gap"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # within one document
    lead = F.length("h") - F.length(F.regexp_replace("h", r"^[\p{Punct}]+", ""))
    df = df.withColumn("start", (F.sum(F.col("gap") + F.length("h")).over(upto) - F.length("h") + lead).cast("int")).withColumn("value", _bare(F.col("h")))
    df = df.where(~F.contains("h", F.lit(MASK)) & (F.col("value") != ""))
    return df.select("key", "start", (F.col("start") + F.length("value")).alias("stop"), "value", F.lower("value").alias("term"))


def _at_least(k: Column, n: Column) -> Column:
    """The lower end of the Wilson interval of a share of which k of n were seen."""
    p, z2 = k / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosures(docs: DataFrame, pairs: DataFrame, values: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, term, disclosure, action) of the terms that reveal a value.

    docs: (text) of all documents; pairs: (key, value, term), values: (key, value) of each text with values.
    """
    joint = pairs.groupBy("value", "term").agg(F.count("*").alias("n_both"))
    joint = scratch.keep(joint.join(values.groupBy("value").agg(F.count("*").alias("n_value")), "value"), "joint")
    distinct = docs.select(text_of().alias("text")).distinct()
    wanted = scratch.keep(joint.select("term").distinct(), "wanted")
    # document counts of all terms, combined before the shuffle, and only then of those that are wanted: the rows of the
    # join grow with the wanted terms, not with how often they occur
    terms = distinct.select(F.explode_outer(F.array_distinct(F.transform(words_of(_plain(text_of())), _term))).alias("term"))
    n_term = terms.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")  # inner: a semi join would be pushed below the counts
    n = docs.select(text_key().alias("key")).distinct().agg(F.greatest(F.count("*"), F.lit(2)).cast("double").alias("n"))  # by keys: whole texts are shuffled once, above
    ic = F.log(F.col("n") / F.least(F.col("n_value").cast("double"), F.col("n") - 1))
    share = _at_least(F.col("n_both").cast("double"), F.greatest("n_term", "n_both").cast("double"))
    pmi = F.log(F.greatest(share, F.lit(1e-12)) * F.col("n") / F.col("n_value").cast("double"))
    out = joint.join(n_term, "term").join(F.broadcast(n)).withColumn("disclosure", F.least(F.lit(1.0), pmi / F.greatest(ic, F.lit(1e-9))))  # n is one row
    return out.where(F.col("disclosure") >= GENERALISE).select("value", "term", "disclosure", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def term_spans(docs: DataFrame, scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, salt, extra): the spans of revealing terms of each text that has some, once for each salt. docs: the corpus; scanned: scan() of it."""
    texts = scratch.keep(scanned.where("held IS NOT NULL").select("key", "held", "base").dropDuplicates(["key"]), "texts")
    values = scratch.keep(texts.select("key", F.explode(F.array_distinct(F.transform("base", lambda x: F.lower(x["value"])))).alias("value")), "values")
    found = scratch.keep(places(texts), "places")
    pairs = scratch.keep(values.join(found.select("key", "term").distinct(), "key"), "pairs")
    told = scratch.keep(disclosures(docs, pairs, values, scratch), "told")
    # by value and term, so that a value of many documents meets only the terms that each of them holds
    met = pairs.join(told, ["value", "term"]).groupBy("key", "term").agg(F.max("action").alias("action"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.concat(F.lit("term_"), "action").alias("kind"), "stop", "value")
    extra = found.join(met, ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list(span)).cast(SPANS).alias("extra"))  # within one document
    kept = scratch.keep(extra.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "extra"), "extra")
    scratch.drop("texts", "values", "places", "pairs", "joint", "wanted", "told")
    return kept


def text_key() -> Column:
    """A key of a text, of 128 bits; copies share it and have equal spans."""
    return F.md5(text_of().cast("binary"))


def _salt(row: str) -> Column:
    return F.pmod(F.col(row), F.lit(SALTS)).cast("int")


def row_key() -> Column:
    """A number of a row's content, to deal copies of a text to parts."""
    return F.xxhash64(F.col("doc_id"), text_of())


def find(docs: DataFrame) -> DataFrame:
    """docs' rows as doc_id, base and extra (array<struct(start, rank, kind, stop, value)>): base spans and revealing terms.

    Null texts are empty and have no spans; null ids, ties and repeated rows are rows like others. An empty table gives
    no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.keep(scan(docs), "scanned")
    extra = term_spans(docs, scanned, scratch)
    return scanned.withColumn("salt", _salt("row")).join(extra, ["key", "salt"], "left").select("doc_id", "base", F.coalesce("extra", F.array().cast(SPANS)).alias("extra"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text redacted: base spans become <EMAIL>, <IP>, <CARD>, <PHONE>; revealing terms go, or become <TERM>.

    Of overlapping spans the first stays, extended over the others. Texts without spans stay as they are, nulls too.
    n_chars, if there, is counted again. All other columns stay.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.keep(scan(docs).where("size(base) > 0"), "scanned")
    extra = term_spans(docs, scanned, scratch).select(F.col("key").alias("_pii_of"), F.col("salt").alias("_pii_part"), F.col("extra").alias("_pii_extra"))
    df = with_base_spans(docs.withColumns({"_pii_text": text_of(), "_pii_key": text_key(), "_pii_row": row_key()}), "_pii_text", "_pii_base")
    df = df.join(extra, (F.col("_pii_key") == F.col("_pii_of")) & (_salt("_pii_row") == F.col("_pii_part")), "left")
    df = df.withColumn("_pii_all", once(F.sort_array(F.concat("_pii_base", F.coalesce("_pii_extra", F.array().cast(SPANS))))))
    mark = lambda x: F.when(x["kind"] == "term_remove", "").when(x["kind"] == "term_generalise", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substr("_pii_text", acc["at"] + 1, x["start"] - acc["at"])
        add = F.when(x["start"] >= acc["at"], F.array(gap, mark(x))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    done = F.aggregate("_pii_all", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr("_pii_text", acc["at"] + 1, F.length("_pii_text"))))
    df = df.withColumn("text", once(F.when(F.size("_pii_all") > 0, done).otherwise(F.col("text"))))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size("_pii_all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")))
    return df.select(*docs.columns)

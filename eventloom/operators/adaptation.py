"""Adaptation programs (ADP-01 to ADP-31)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import once
from ..functions.medians import group_medians
from ..functions.scratch import cut, new_folder, remove_at_end
from . import components


def unregistered_metrics(programs: DataFrame, registry: DataFrame) -> DataFrame:
    """ADP-01. (id, name) of program metrics that registry(id) lacks; a missing or empty name is __missing__."""
    m = programs.select(F.col("id"), F.explode("metrics").alias("m")).select("id", F.coalesce(F.nullif(F.col("m.name"), F.lit("")), F.lit("__missing__")).alias("name"))
    return m.join(registry.select(F.col("id").alias("name")), "name", "left_anti").select("id", "name")


def prf(gold: DataFrame, pred: DataFrame, key: list[str], dims: list[str]) -> DataFrame:
    """ADP-02, ADP-03. True and false positives, false negatives, precision, recall and F1 by dims; key with dims identifies an item."""
    cols = [*dims, *key]
    met = gold.select(*cols, F.lit(1).alias("g")).distinct().join(pred.select(*cols, F.lit(1).alias("p")).distinct(), cols, "full_outer")
    n = met.groupBy(*dims).agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    return rates(n)


def rates(n: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


entity_prf = relation_prf = prf


def aggregate_metric(found: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """ADP-04. F1 over the rows of prf(): macro (mean), micro (from summed counts), weighted (by support), per_class or per_topic (by the given columns)."""
    by = by or []
    if how == "macro":
        return found.groupBy(*by).agg(F.avg("f1").alias("value"))
    if how == "weighted":
        w = F.col("tp") + F.col("fn")
        return found.groupBy(*by).agg((F.sum(F.col("f1") * w) / F.greatest(F.sum(w), F.lit(1))).alias("value"))
    return rates(found.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).select(*by, F.col("f1").alias("value"))


def f1_shape(found: DataFrame, kind: str, topic: str) -> DataFrame:
    """ADP-05. One row: overall F1, and maps of F1 by type and by topic. The maps have one entry a type or topic."""
    pack = lambda c, name: aggregate_metric(found, "micro", [c]).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "value")))).alias(name))
    return aggregate_metric(found, "micro").withColumnRenamed("value", "overall").join(F.broadcast(pack(kind, "per_type"))).join(F.broadcast(pack(topic, "per_topic")))  # one row each


def annotation_minutes(annotations: DataFrame, dims: list[str], exact: bool = True) -> DataFrame:
    """ADP-06. Median minutes a document by dims; exact=False for an approximate one at scale."""
    if not exact:
        return annotations.groupBy(*dims).agg(F.percentile_approx("minutes", 0.5).cast("double").alias("minutes"), F.count("*").alias("n"))
    n, m = annotations.groupBy(*dims).agg(F.count("*").alias("n")).alias("n"), group_medians(annotations, dims, "minutes", "minutes").alias("m")
    met = n.join(m, [F.col(f"n.{c}").eqNullSafe(F.col(f"m.{c}")) for c in dims])
    return met.select(*[F.col(f"n.{c}").alias(c) for c in dims], F.col("m.minutes").alias("minutes"), F.col("n.n").alias("n"))


def topic_drift_kl(weights: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """ADP-07. Of (topic, window as a number, term, weight): KL divergence of each window from the one before, epsilon added to every term of either, natural log."""
    w = weights.groupBy("topic", "window", "term").agg(F.sum("weight").alias("weight"))
    cols = ["topic", "window", "term"]
    now = w.withColumnRenamed("weight", "p")
    before = w.select("topic", (F.col("window") + 1).alias("window"), "term", F.col("weight").alias("q"))
    pairs = w.select("topic", "window").distinct()
    pairs = pairs.join(pairs.select("topic", (F.col("window") + 1).alias("window")), ["topic", "window"], "left_semi")
    met = now.join(before, cols, "full_outer").join(pairs, ["topic", "window"], "left_semi").withColumns({"p": F.coalesce("p", F.lit(0.0)) + epsilon, "q": F.coalesce("q", F.lit(0.0)) + epsilon})
    both = Window.partitionBy("topic", "window")
    met = met.withColumns({"p": F.col("p") / F.sum("p").over(both), "q": F.col("q") / F.sum("q").over(both)})
    return met.groupBy("topic", "window").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def metric_range_check(values: DataFrame, registry: DataFrame) -> DataFrame:
    """ADP-08. values(metric, value, ...) outside the registered range; a null bound is open."""
    met = values.join(registry.select(F.col("id").alias("metric"), F.get("range", F.lit(0)).alias("lo"), F.get("range", F.lit(1)).alias("hi")), "metric")
    return met.where("value < lo OR value > hi")


def metric_delta(baseline: DataFrame, treatment: DataFrame, dims: list[str]) -> DataFrame:
    """ADP-09. Treatment minus baseline of value by dims; null where a side lacks it."""
    met = baseline.select(*dims, F.col("value").alias("baseline")).join(treatment.select(*dims, F.col("value").alias("treatment")), dims, "full_outer")
    return met.withColumn("delta", F.col("treatment") - F.col("baseline"))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (program, side, key, threshold) with metric and op: the key splits at its last dot."""
    return rules.withColumns({"op": F.substring_index("key", ".", -1), "metric": F.regexp_extract("key", r"^(.*)\.[^.]*$", 1)})


def decide(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """ADP-10. (program, decision) of metrics(program, metric, value, delta) and rules(program, side, key, threshold).

    An operation is delta_gte, delta_lt, min_gte or min_lt. rollback if one rollback rule holds; else promote if all
    promote rules do; else hold; none if the program has no metrics.
    """
    r = rule_table(rules).join(metrics, ["program", "metric"], "left")
    x = F.when(F.col("op").startswith("delta"), F.col("delta")).otherwise(F.col("value"))
    holds = F.coalesce(F.when(F.col("op").endswith("_gte"), x >= F.col("threshold")).otherwise(x < F.col("threshold")), F.lit(False))
    by = r.withColumn("holds", holds).groupBy("program").agg(F.max(F.when(F.col("side") == "rollback_if", F.col("holds"))).alias("back"), F.min(F.when(F.col("side") == "promote_if", F.col("holds"))).alias("up"), F.count("value").alias("n"))
    return by.select("program", F.when(F.col("n") == 0, "none").when(F.coalesce("back", F.lit(False)), "rollback").when(F.coalesce("up", F.lit(False)), "promote").otherwise("hold").alias("decision"))


def metric_constraints(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """ADP-11. metrics(program, metric, value) under min_overall of limits(program, metric, min_overall)."""
    return metrics.join(limits, ["program", "metric"]).where("value < min_overall")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fit_topics(docs: DataFrame, method: str = "lda", k: int = 4, seed: int = 7, vocab: int = 2000, rounds: int = 10):
    """ADP-12. A topic model of docs(doc_id, text): lda (MLlib), lsi (raw counts) or lsa (TF-IDF), both by singular vectors.

    Returns (vectors: doc_id, v; vocabulary; model), where model is an LDAModel or an array terms x k. The sign of a
    singular vector is free: its largest component in size is made positive, the first of equal ones.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import IDF, CountVectorizer

    d = docs.select("doc_id", _words(F.col("text")).alias("w"))
    cv = CountVectorizer(inputCol="w", outputCol="v", vocabSize=vocab, minDF=2.0).fit(d)
    v = cut(cv.transform(d).select("doc_id", "v"))  # fitting passes over the vectors, not over the texts
    if method == "lda":
        return v, cv.vocabulary, LDA(k=k, seed=seed, maxIter=rounds, featuresCol="v", optimizer="online").fit(v)
    if method == "lsa":
        v = IDF(inputCol="v", outputCol="t").fit(v).transform(v).select("doc_id", F.col("t").alias("v"))
    return v, cv.vocabulary, singular_axes(v, k)[0]


def singular_axes(vectors: DataFrame, k: int):
    """The first k right singular vectors of the rows of vectors(v), as columns, and the singular values. Rows stay sparse and
    in the JVM, and are passed once: the driver gets the products of the terms, of the vocabulary's chosen size squared."""
    import numpy as np
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    found, axes = np.linalg.eigh(RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("v"), "v")).computeGramianMatrix().toArray())
    found, axes = found[::-1][:k], axes[:, ::-1][:, :k]
    top = axes[np.abs(np.round(axes, 9)).argmax(axis=0), np.arange(axes.shape[1])]
    return axes * np.where(top < 0, -1.0, 1.0), np.sqrt(np.maximum(found, 0))


def _stored(vectors: DataFrame) -> DataFrame:
    """(doc_id, i, x): places and values of the components that vectors(doc_id, v) stores. A written vector is a struct of
    them, so they are read without making it dense."""
    spark, path = vectors.sparkSession, new_folder(vectors.sparkSession, "vectors")
    vectors.select("doc_id", "v").write.parquet(path)
    parts = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    rows = spark.read.schema(f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, v {parts}").parquet(remove_at_end(spark, path))
    return rows.select("doc_id", F.coalesce("v.indices", F.transform("v.values", lambda x, i: i)).alias("i"), F.col("v.values").alias("x"))


def topic_membership(vectors: DataFrame, model, fn: str) -> DataFrame:
    """ADP-13. (doc_id, topic_id, membership) by lda_theta, or by lsi_cosine or lsa_cosine (cosine with the topic's axis; 0 for a vector without components)."""
    from pyspark.ml.functions import vector_to_array

    if fn == "lda_theta":
        return model.transform(vectors).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic_id", "membership"))
    axes = model / ((model**2).sum(axis=0, keepdims=True) ** 0.5)  # terms x topics, of a chosen size
    add = lambda s, x: s + x
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda axis: F.aggregate(F.zip_with("i", "x", lambda i, x: x * F.get(F.lit(axis).cast("array<double>"), i)), F.lit(0.0), add)
    each = F.array(*(F.when(size > 0, dot(axes[:, k].tolist()) / size).otherwise(0.0) for k in range(axes.shape[1])))
    return _stored(vectors).select("doc_id", F.posexplode(each).alias("topic_id", "membership"))


def topic_signature(model, vocabulary: list[str], docs: DataFrame, membership: DataFrame, n: int) -> DataFrame:
    """ADP-14. (topic_id, top_terms, top_phrases) of an LDA model: terms by weight, and the bigrams most frequent in documents whose main topic it is."""
    spark = docs.sparkSession
    vocab = spark.createDataFrame(list(enumerate(vocabulary)), "i int, term string")  # of a chosen size
    terms = model.describeTopics(n).select(F.col("topic").alias("topic_id"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("topic_id", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    terms = terms.join(F.broadcast(vocab), "i").groupBy("topic_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("weight", "term")))).alias("top_terms"))
    main = membership.groupBy("doc_id").agg(F.max_by("topic_id", "membership").alias("topic_id"))
    texts = docs.select("doc_id", "text").join(main, "doc_id").select("topic_id", once(_words(F.col("text"))).alias("w"))  # a row a document meets its topic, not a row a bigram
    grams = texts.select("topic_id", F.explode(ngrams(F.col("w"), 2)).alias("g")).groupBy("topic_id", "g").agg(F.count("*").alias("n"))
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("n"), "g"))).where(F.col("r") <= n).groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "g"))), lambda x: x["g"]).alias("top_phrases"))
    return terms.join(top, "topic_id", "left")


def activation_gate(membership: DataFrame, at_least: float | None = None, top_k: int | None = None) -> DataFrame:
    """ADP-15. (doc_id, topic_id) where the layer is active: membership at or above a threshold, and the topic among the document's top k."""
    m = membership if at_least is None else membership.where(F.col("membership") >= at_least)
    if top_k is not None:
        rank = membership.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("membership"), "topic_id"))).where(F.col("r") <= top_k)
        m = rank if at_least is None else rank.where(F.col("membership") >= at_least)
    return m.select("doc_id", "topic_id")


def applies_to(docs: DataFrame, plan: dict[str, list | None]) -> DataFrame:
    """ADP-16. docs within the plan's lists by column; an absent list does not limit."""
    for c, allowed in plan.items():
        if allowed is not None:
            docs = docs.where(F.col(c).isin(*allowed))
    return docs


def compose_spaces(layers: list[tuple[DataFrame, str]]) -> DataFrame:
    """ADP-17. (key, payload) of layers in plan order: merge adds and replaces, overrides_only replaces what is there, append_only adds what is not."""
    out = None
    for layer, mode in layers:
        layer = layer.select("key", F.col("payload").alias("new"), F.lit(True).alias("has"))
        if out is None:
            out = layer.select("key", F.col("new").alias("payload")) if mode != "overrides_only" else layer.limit(0).select("key", F.col("new").alias("payload"))
            continue
        met = out.withColumn("had", F.lit(True)).join(layer, "key", "left" if mode == "overrides_only" else "full_outer")
        value = F.when(F.col("had").isNotNull(), F.col("payload")).otherwise(F.col("new")) if mode == "append_only" else F.when(F.col("has").isNotNull(), F.col("new")).otherwise(F.col("payload"))
        out = met.select("key", value.alias("payload"))
    return out


def resolve_conflicts(artifacts: DataFrame, strategy: str, pinned: list[str] | None = None) -> DataFrame:
    """ADP-18. (key, payload) of (key, layer, artifact_id, payload): ranked_layers, pinned_overrides, vote or deny_on_conflict."""
    last = [F.desc("layer"), F.desc("artifact_id")]
    if strategy == "deny_on_conflict":
        return artifacts.groupBy("key").agg(F.count_distinct("payload").alias("n"), F.first("payload").alias("payload")).where("n = 1").select("key", "payload")
    if strategy == "vote":
        n = artifacts.groupBy("key", "payload").agg(F.count("*").alias("n"), F.max("layer").alias("layer"))
        return n.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.desc("layer"), "payload"))).where("r = 1").select("key", "payload")
    order = [F.desc(F.col("artifact_id").isin(*(pinned or [])).cast("int")), *last] if strategy == "pinned_overrides" else last
    return artifacts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("r = 1").select("key", "payload")


PLANS = ["free", "premium", "enterprise"]


def entitled(plans: DataFrame, principals: DataFrame) -> DataFrame:
    """ADP-19. (plan_id, principal): all of plans(plan_id, required_actions, min_plan) held by principals(principal, actions, plan). Plans are a small table; the join is by action of the plan's first, or any plan without actions."""
    rank = lambda c: F.array_position(F.array(*[F.lit(p) for p in PLANS]), c)
    need = plans.select("plan_id", "required_actions", "min_plan", F.explode_outer(F.array_distinct("required_actions")).alias("action"), F.size(F.array_distinct("required_actions")).alias("n"))
    free = need.where("n <= 0").select("plan_id", "min_plan")
    held = principals.select("principal", "plan", F.explode(F.array_distinct("actions")).alias("action"))
    ok = need.join(held, "action").groupBy("plan_id", "principal", "min_plan", "plan", "n").agg(F.count("*").alias("have")).where("have = n").select("plan_id", "principal", "min_plan", "plan")
    # plans without actions are met by the plans up to the principal's own: an equi join
    upto = F.slice(F.array(*[F.lit(p) for p in PLANS]), 1, F.coalesce(rank(F.col("plan")), F.lit(0)).cast("int"))
    open_ = principals.select("principal", F.explode(upto).alias("min_plan")).join(free, "min_plan").select("plan_id", "principal")
    return ok.where(rank(F.col("plan")) >= rank(F.col("min_plan"))).select("plan_id", "principal").unionByName(open_)


def semver(c: Column) -> Column:
    """Numeric parts of x.y.z, for comparison as an array."""
    return F.transform(F.split(F.regexp_replace(c, r"[-+].*$", ""), r"\."), lambda x: x.try_cast("int"))


def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """ADP-20. Latest approved version of each artifact id by numeric semver."""
    w = Window.partitionBy("id").orderBy(F.desc(semver(F.col("version"))), F.desc("version"))
    return artifacts.where("status = 'approved'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def verify_digests(artifacts: DataFrame) -> DataFrame:
    """ADP-21. Counts of artifacts whose digest is, or is not, sha256: of the payload's text."""
    good = F.coalesce(F.col("digest") == F.concat(F.lit("sha256:"), F.sha2(F.col("payload").cast("binary"), 256)), F.lit(False))
    return artifacts.groupBy(F.when(good, "ok").otherwise("bad").alias("outcome")).agg(F.count("*").alias("n"))


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


FLAGS = 1 << 17  # bits that say whether a word may begin a term


def _flag(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FLAGS)).cast("int")


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, first, ahead) for the places of docs(doc_id, text) whose word may begin one of terms(t, first), with the words
    there up to the longest term's length. A fixed number of bits tells, whatever the number of terms."""
    # collected: FLAGS / 32 numbers at most
    marks = terms.select(_flag(F.col("first")).alias("f")).groupBy((F.col("f") / 32).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, f % 32)")).alias("bits")).collect()
    longest = terms.agg(F.max(F.size("t"))).first()[0] or 1
    bits = [0] * (FLAGS // 32)
    for r in marks:
        bits[r["at"]] = r["bits"]
    table = F.lit(bits).cast("array<long>")
    w = docs.select("doc_id", once(_words(F.col("text"))).alias("w")).withColumn("f", once(F.transform("w", _flag))).where("size(w) > 0")
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.call_function("shiftright", F.get(table, (F.get("f", i - 1) / 32).cast("int")), F.get("f", i - 1) % 32).bitwiseAND(1) == 1)
    return w.select("doc_id", F.explode(F.transform(at, lambda i: F.slice("w", i, longest))).alias("ahead")).select("doc_id", F.get("ahead", F.lit(0)).alias("first"), "ahead")


def apply_dictionary(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ADP-22. (doc_id, term, n): dictionary(term) terms of any number of words in docs(doc_id, text), as whole words in lower case.

    Terms are indexed by their first word. Only places whose word may begin a term become rows; there the words of the
    terms that begin so are compared.
    """
    terms = dictionary.select(_words(F.col("term")).alias("t"), F.lower("term").alias("term")).where("size(t) > 0").distinct()
    terms = cut(terms.select("term", "t", F.get("t", F.lit(0)).alias("first")))
    met = term_places(docs, terms).join(terms, "first").where(F.slice("ahead", F.lit(1), F.size("t")) == F.col("t"))
    return met.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def apply_regex_rules(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """ADP-23. (doc_id, rule, match) of every match of each rule (name: pattern); the rules are a few constants of the plan."""
    hits = F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.regexp_extract_all(F.col("text"), F.lit(f"({p})"), F.lit(1)) for p in rules.values()]))
    return docs.select("doc_id", F.explode(hits).alias("rule", "m")).select("doc_id", "rule", F.explode("m").alias("match"))


def ngram_rankings(docs: DataFrame, scope: str, n: int, k: int) -> DataFrame:
    """ADP-24. The k most frequent n-grams of each scope, ties in text order."""
    g = docs.select(scope, once(_words(F.col("text"))).alias("w")).select(scope, F.explode(ngrams(F.col("w"), n)).alias("gram")).groupBy(scope, "gram").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= k)


def patch_taxonomy(entities: DataFrame, patch: DataFrame, defined: list[str]) -> DataFrame:
    """ADP-25. entities(type, ...) with types renamed by patch(type, to) or dropped where to is null; unknown marks types outside the defined set."""
    met = entities.join(patch.select("type", "to", F.lit(True).alias("hit")), "type", "left").where("hit IS NULL OR to IS NOT NULL")
    return met.withColumn("type", F.coalesce("to", "type")).drop("to", "hit").withColumn("unknown", ~F.col("type").isin(*defined))


def artifact_lineage(inputs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """ADP-26. (artifact, ancestor, distance) over inputs(artifact, input), to the last ancestor, in rounds that double the distance; cycles end by themselves.

    With runs(artifact, run_id, metric, value), the supporting runs of artifacts, a row for each metric of each run that
    supports the ancestor, or one with nulls.
    """
    found = components.closure(inputs.select(F.col("artifact").alias("src"), F.col("input").alias("dst"))).select(F.col("src").alias("artifact"), F.col("dst").alias("ancestor"), "distance")
    return found if runs is None else supporting_runs(found, runs)


RUNS, BELOW = 1024, 4096  # runs of an ancestor, and artifacts below it, that meet in one task


def supporting_runs(lineage: DataFrame, runs: DataFrame) -> DataFrame:
    """(artifact, ancestor, distance, run_id, metric, value): each row of lineage with each of runs(artifact, run_id, metric, value) of its ancestor, or with nulls.

    An ancestor's runs and the artifacts below it are dealt to tiles, and each pair of tiles is a join key of its own, so a
    few ancestors give many keys of one size. Rows of a run stand together, which Parquet stores in a few bits a row.
    """
    r = runs.select(F.col("artifact").alias("ancestor"), "run_id", "metric", "value").where("ancestor IS NOT NULL")
    tiles = lambda df, n, name: cut(df.groupBy("ancestor").agg(F.count("*").alias(f"{name}_rows"), F.ceil(F.count("*") / n).cast("int").alias(name)))
    n_runs, n_below = tiles(r, RUNS, "nr"), tiles(lineage, BELOW, "nb")
    rows = n_runs.join(n_below, "ancestor").agg(F.sum(F.col("nr_rows").cast("double") * F.col("nb_rows"))).first()[0] or 0
    dealt = max(min(math.ceil(rows / (RUNS * BELOW)), 2000), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    below = lineage.join(n_runs, "ancestor", "left").join(n_below, "ancestor", "left")
    alone = below.where("nr IS NULL").select("artifact", "ancestor", "distance", *(F.lit(None).cast(r.schema[c].dataType).alias(c) for c in ("run_id", "metric", "value")))
    below = below.where("nr IS NOT NULL").select("artifact", "ancestor", "distance", F.pmod(F.xxhash64("artifact"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("a"))
    r = r.join(n_runs, "ancestor").join(n_below, "ancestor")
    r = r.select("ancestor", "run_id", "metric", "value", F.pmod(F.xxhash64("run_id", "metric"), F.col("nr")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    met = r.repartition(dealt, "ancestor", "a", "b").join(below.hint("merge"), ["ancestor", "a", "b"])
    return met.select("artifact", "ancestor", "distance", "run_id", "metric", "value").unionByName(alone)


def artifact_rollup(artifacts: DataFrame, cols: list[str]) -> DataFrame:
    """ADP-27. Counts by the columns with all subtotals; level is grouping_id."""
    return artifacts.cube(*cols).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def split_datasets(programs: DataFrame, docs: DataFrame) -> DataFrame:
    """ADP-28. (program, split, doc_id): programs(id, datasets map of split to names) against docs(doc_id, dataset)."""
    d = programs.select(F.col("id").alias("program"), F.explode("datasets").alias("split", "names")).select("program", "split", F.explode("names").alias("dataset"))
    return d.join(docs.select("doc_id", "dataset"), "dataset").select("program", "split", "doc_id")


def flat_runs(programs: DataFrame) -> DataFrame:
    """ADP-29. A row for each run of programs(id, runs array of run_id, status, decision, started_at, finished_at): (id, run_id, status, decision, seconds)."""
    r = programs.select("id", F.explode("runs").alias("r")).select("id", "r.*")
    return r.select("id", "run_id", "status", "decision", (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("seconds"))


def program_runs(programs: DataFrame) -> DataFrame:
    """ADP-29. By program: runs, mean seconds, and a column for each decision and each status, in one aggregate."""
    count = lambda c, x, name: F.count_if(F.col(c) == x).alias(name)
    decisions = [count("decision", x, x) for x in ("promote", "hold", "rollback", "none")]
    statuses = [count("status", x, f"n_{x}") for x in ("queued", "running", "completed", "failed")]
    return flat_runs(programs).groupBy("id").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"), *decisions, *statuses)


def plan_objective_met(deltas: DataFrame, plans: DataFrame) -> DataFrame:
    """ADP-30. plans(plan_id, program, primary_metric, target_gain) with gain and met, against deltas(program, metric, delta)."""
    m = plans.join(deltas.select("program", F.col("metric").alias("primary_metric"), F.col("delta").alias("gain")), ["program", "primary_metric"], "left")
    return m.withColumn("met", F.coalesce(F.col("gain") >= F.col("target_gain"), F.lit(False)))


def topic_centroids(membership: DataFrame, embeddings: DataFrame) -> DataFrame:
    """ADP-31. (topic_id, dim, x): membership-weighted mean of embeddings(id, embedding) by topic of membership(id, topic_id, membership)."""
    e = embeddings.select("id", F.posexplode("embedding").alias("dim", "x"))
    met = membership.join(e, "id")
    return met.groupBy("topic_id", "dim").agg((F.sum(F.col("x") * F.col("membership")) / F.sum("membership")).alias("x"))


def store_centroids(centroids: DataFrame, path: str, space: str) -> DataFrame:
    """ADP-31. Stores topic_centroids as (space, topic_id, centroid), a row a topic, in the table at path; returns (topic_id, centroid_embedding_ref), where a reference is path#space/topic_id. A space that is stored again replaces itself."""
    spark = centroids.sparkSession
    rows = centroids.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("c"))  # of the embeddings' width
    rows = rows.select(F.lit(space).alias("space"), "topic_id", F.transform("c", lambda v: v["x"]).alias("centroid"))
    rows.write.mode("overwrite").partitionBy("space").option("partitionOverwriteMode", "dynamic").parquet(path)
    return spark.read.parquet(path).where(F.col("space") == space).select("topic_id", F.concat(F.lit(f"{path}#{space}/"), F.col("topic_id").cast("string")).alias("centroid_embedding_ref"))


def read_centroids(spark, refs: DataFrame) -> DataFrame:
    """ADP-31. refs(centroid_embedding_ref, ...) with the centroid that each points to; the tables that refs name are few."""
    at = refs.withColumns({"_path": F.substring_index("centroid_embedding_ref", "#", 1), "_key": F.substring_index("centroid_embedding_ref", "#", -1)})
    paths = [r["_path"] for r in at.select("_path").distinct().collect()]
    out = None
    for p in paths:
        t = spark.read.parquet(p).select(F.lit(p).alias("_path"), F.concat_ws("/", "space", F.col("topic_id").cast("string")).alias("_key"), "centroid")
        out = t if out is None else out.unionByName(t)
    return (at.join(out, ["_path", "_key"]) if out is not None else at.withColumn("centroid", F.lit(None).cast("array<double>"))).drop("_path", "_key")

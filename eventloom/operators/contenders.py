"""Champion and challenger evaluation (CCE-01 to CCE-12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, word_edits


def pool_embeddings(tokens: DataFrame, pooling: str = "mean") -> DataFrame:
    """CCE-01. Of (doc_id, pos, mask, vector): mean of the unmasked vectors by dimension, their number taken as 1 at least; cls: the first token's vector."""
    if pooling == "cls":
        return tokens.groupBy("doc_id").agg(F.min_by("vector", "pos").alias("embedding"))
    each = tokens.select("doc_id", "mask", F.posexplode("vector").alias("dim", "x"))
    mean = each.groupBy("doc_id", "dim").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("x"))
    return mean.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))  # one entry a dimension


def score_batches(df: DataFrame, load: Callable[[], Callable], schema: str, batch_size: int = 64) -> DataFrame:
    """CCE-02. A user's model over batches of batch_size rows: load() runs once a task and returns a function of a pandas frame to one."""

    def run(batches: Iterator):
        infer = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                yield infer(pdf.iloc[at : at + batch_size])

    return df.mapInPandas(run, schema)


def argmax_label(logits: Column) -> Column:
    """CCE-03. Index of the greatest value, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def accuracy(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """CCE-04. preds(model, id, pred) against labels(id, label)."""
    return preds.join(labels, "id").groupBy("model").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def cosine_metric(df: DataFrame, by: list[str], emb: str, target: str) -> DataFrame:
    """CCE-05. Mean cosine of embedding and target."""
    return df.groupBy(*by).agg(F.avg(cosine(F.col(emb), F.col(target))).alias("cosine"))


def wer(df: DataFrame, by: list[str], ref: str, hyp: str) -> DataFrame:
    """CCE-06. Summed word edits over summed reference words."""
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda x: x != "")
    d = df.select(*by, words(ref).alias("r"), words(hyp).alias("h"))
    return d.groupBy(*by).agg(F.sum(word_edits(F.col("r"), F.col("h"))).cast("long").alias("edits"), F.sum(F.size("r")).cast("long").alias("words")).withColumn("wer", F.col("edits") / F.greatest("words", F.lit(1)))


def exact_match(df: DataFrame, by: list[str], output: str, target: str) -> DataFrame:
    """CCE-07. Share of outputs equal to the target, blanks at the ends aside."""
    return df.groupBy(*by).agg(F.avg((F.trim(output) == F.trim(target)).cast("double")).alias("exact_match"))


def compare_contenders(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """CCE-08. metrics(task, metric, role, value) against policy(task, metric, threshold): a negative threshold means that less is better."""
    p = metrics.groupBy("task", "metric").pivot("role", ["champion", "challenger"]).agg(F.first("value"))
    d = p.join(policy, ["task", "metric"]).withColumn("delta", F.col("challenger") - F.col("champion"))
    good = F.when(F.col("threshold") < 0, F.col("delta") <= F.col("threshold")).otherwise(F.col("delta") >= F.col("threshold"))
    return d.withColumn("promote", F.coalesce(good, F.lit(False)))


def eval_sample(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """CCE-09. limit rows, the same in each run: by md5 of the id, then id. A sampling operator."""
    return df.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(limit)


def bucket_of(key: Column) -> Column:
    """A key's place in 0 to 999999: the first 8 hexadecimal digits of its md5, modulo a million."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000


def route_traffic(requests: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """CCE-10. requests with model: stable by key, in proportion to the weights (in the order given)."""
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        at += w
        hit = bucket_of(F.col(key)) < round(1_000_000 * at / total)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return requests.withColumn("model", out)


def online_rewards(scored: DataFrame, width: str) -> DataFrame:
    """CCE-11. Of (model, task, at, reward): mean reward and number by time bucket."""
    return scored.groupBy("model", "task", F.window("at", width).alias("w")).agg(F.avg("reward").alias("reward"), F.count("*").alias("n")).select("model", "task", F.col("w.start").alias("bucket"), "reward", "n")


def leaderboard(metrics: DataFrame, less_is_better: list[str]) -> DataFrame:
    """CCE-12. metrics(task, metric, model, value) with their dense rank in task and metric."""
    key = F.when(F.col("metric").isin(*less_is_better), F.col("value")).otherwise(-F.col("value"))
    return metrics.withColumn("rank", F.dense_rank().over(Window.partitionBy("task", "metric").orderBy(key)))

"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part learns that terms together mean
more than each does alone. Terms are hashed words and hashed word starts; every term that MIN_TEXTS training texts have
is in the machine. x_i = s_i (1 + ln(count of term i)), brought to length 1 in each text; s_i, from LOW to 1, is the
term's correlation with the label: terms that say little alone weigh less in the fit, but none is left out, and pairs of
such terms are learned as well. Fitted on labelled rows with the least hash of the id, MAX_TRAIN of them and MAX_TERMS
distinct terms in all at most; scoring covers every row and whole texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, crc_mod5

MAX_TRAIN = 12_000  # rows; and of their distinct terms, 8 bytes each, so many:
MAX_TERMS = 8_000_000
MIN_TEXTS = 5  # training texts that a term of the machine stands in at least
LOW = 0.02  # least scale of a term
BITS = 18  # hash values of terms
FACTORS = 6
START = 5  # letters of a word start
_WORD = re.compile(r"[^\W\d_]+")


def hashed_terms(text: str | None, memo: dict) -> np.ndarray:
    """Hash values of the terms of a text, repeats included: each word, and each word's start if it is longer."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        h = memo.get(w)
        if h is None:
            if len(memo) > 200_000:
                memo.clear()
            b = w.encode()
            h = (zlib.crc32(b) & (1 << BITS) - 1,) + ((zlib.crc32(b"^" + w[:START].encode()) & (1 << BITS) - 1,) if len(w) > START else ())
            memo[w] = h
        out += h
    return np.array(out, np.int32)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids, return_counts=True) if len(ids) else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Machine:
    """A fitted model: slot[h] is the row of hash value h in scale, w and v, or -1."""

    def __init__(self, slot, scale, w0, w, v):
        self.slot, self.scale, self.w0, self.w, self.v = slot, scale, w0, w, v

    def features(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values x of a text's terms."""
        at = self.slot[h]
        n, at = n[at >= 0], at[at >= 0]
        x = (1 + np.log(n)) * self.scale[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-9)

    def score(self, ids: np.ndarray) -> float:
        at, x = self.features(*counted(ids))
        vx = self.v[at] * x[:, None]
        z = self.w0 + self.w[at] @ x + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7, steps: int = 280, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, lift: float = 3.0) -> Machine:
    """Adam on the log loss of rows (distinct terms, counts), toxic ones weighing lift times. Without both labels, a constant machine."""
    slot, n = np.full(1 << BITS, -1, np.int32), len(y)
    n1 = int(y.sum())
    if not n1 or n1 == n:
        return Machine(slot, np.zeros(0), 4.0 if n1 else -4.0, np.zeros(0), np.zeros((0, FACTORS)))
    df = np.zeros((2, 1 << BITS))
    for (h, _), label in zip(rows, y, strict=True):
        df[int(label), h] += 1
    known = np.flatnonzero(df.sum(0) >= MIN_TEXTS)
    slot[known] = np.arange(len(known))
    p, q = (df[1, known] + 0.5) / (n1 + 1), (df[0, known] + 0.5) / (n - n1 + 1)
    mean = (df[:, known].sum(0) + 1) / (n + 2)
    scale = np.clip(np.abs(p - q) / np.sqrt(mean * (1 - mean)), LOW, 1)
    rng, size = np.random.default_rng(seed), len(known)
    now = [np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)]
    means, squares = [np.zeros_like(a) for a in now], [np.zeros_like(a) for a in now]
    machine = Machine(slot, scale, 0.0, now[1], now[2])
    x_of = [machine.features(h, c) for h, c in rows]
    weight = np.where(y > 0, lift, 1.0)
    order: list[int] = []
    for t in range(1, steps + 1):
        if len(order) < min(batch, n):
            order = rng.permutation(n).tolist()
        some, order = order[:batch], order[batch:]
        at, x = (np.concatenate([x_of[i][k] for i in some]) for k in (0, 1))
        of, m = np.repeat(np.arange(len(some)), [len(x_of[i][0]) for i in some]), len(some)
        (w0, w, v), at = now, at.astype(np.int64)
        vx = v[at] * x[:, None].astype(np.float32)
        xv = np.stack([np.bincount(of, vx[:, k], m) for k in range(FACTORS)], 1)
        z = w0 + np.bincount(of, w[at] * x, m) + 0.5 * ((xv**2).sum(1) - np.bincount(of, (vx * vx).sum(1), m))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / weight[some].sum()
        gx = g[of] * x
        gv = gx[:, None] * (xv[of] - vx)
        grads = [g.sum(keepdims=True), np.bincount(at, gx, size) + decay * w, np.stack([np.bincount(at, gv[:, k], size) for k in range(FACTORS)], 1) + decay * v]
        for a, d, first, second in zip(now, grads, means, squares, strict=True):
            first += 0.1 * (d - first)
            second += 0.001 * (d * d - second)
            a -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Machine(slot, scale, float(now[0][0]), *now[1:])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted on labelled rows whose crc32(doc_id as text) mod 5 is not 0: MAX_TRAIN of them at most, with MAX_TERMS distinct terms in all."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(crc_mod5() != 0)
    some = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)

    def terms(batches):
        import pandas as pd

        memo: dict = {}
        for pdf in batches:
            found = [counted(hashed_terms(t, memo)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "n_terms": [len(h) for h, _ in found], "terms": [h.astype(np.int32).tobytes() + n.astype(np.int32).tobytes() for h, n in found]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(F.broadcast(some), "doc_id").mapInPandas(terms, "doc_id long, y int, n_terms int, terms binary")  # MAX_TRAIN ids, of 12 bytes
    # of an id that several rows have, one text; rows in the order of the hash while their terms fit
    got = Scratch(docs.sparkSession).keep(got.groupBy("doc_id").agg(F.min_by(F.struct("y", "n_terms", "terms"), F.struct("n_terms", "terms")).alias("r")).select("doc_id", "r.*"), "terms")
    upto = F.sum("n_terms").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over MAX_TRAIN rows of numbers
    fits = got.select("doc_id", "n_terms").withColumn("upto", upto).where(F.col("upto") <= MAX_TERMS).select("doc_id")
    found = got.join(fits, "doc_id").toPandas().sort_values("doc_id")
    halves = [np.frombuffer(b, np.int32) for b in found["terms"]]
    return fit([(x[: len(x) // 2], x[len(x) // 2 :]) for x in halves], found["y"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text): null texts are empty. Only the text is an input of the score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        import pyarrow as pa

        memo: dict = {}
        for b in batches:
            s = [model.value.score(hashed_terms(t, memo)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod5() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() with a machine from train(). Without usable labels all scores are alike and low. Repeated rows stay, equal texts score alike; rows without doc_id stay; very long texts are scored whole; an empty table gives no rows. Other columns are ignored."""
    return score(docs, train(docs, labels))

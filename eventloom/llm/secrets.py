"""Secret scans: base patterns, and strings that a character Markov model of random strings likes better than one of ordinary text.

Both models are of order 2 over the characters of credentials. Labelled samples come from the corpus itself: values
that a base pattern finds are random strings; all other runs of those characters are ordinary identifiers and words.
Runs that no base pattern finds and that may be random by their shape (see _unlabelled) have no label and train neither;
nor do runs that touch a base match. Every run of 8 or more, less the base spans in it, is a candidate; the evidence
alone decides.
Transitions are counted over all documents; the tables have a fixed size.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINT = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
HEAD, TAIL = re.compile(r"\A[A-Za-z0-9+/_=-]+"), re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]+\Z")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(CHARS) + 1  # and one for the start of a string
CODE = np.full(256, -1, np.int64)
CODE[list(CHARS.encode())] = np.arange(1, N)
PRIOR = 20.0  # observations that the order below counts for
MIN_LLR = 0.5  # nats a character by which the random model must win
MIN_EVIDENCE = 12.0  # and nats in all


def base_spans(t: str) -> list[tuple[int, int, str, int, int]]:
    """(start, rank of kind, kind, end, start of the value) of each base match, sorted."""
    out = []
    if HINT.search(t):
        out += [(m.start(), 0, "assign", m.end(), m.start(1)) for m in ASSIGN.finditer(t) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in t:
        out += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(t)]
    return sorted(out)


def transitions(strings: list[bytes]) -> np.ndarray:
    """Flat (context, character) numbers of the strings' characters; other characters end a string and start another."""
    data = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8)
    c = CODE[data]
    ok = c >= 0
    c = np.where(ok, c, 0)
    p1 = np.concatenate(([0], c[:-1]))
    p2 = np.concatenate(([0, 0], c[:-2]))[: len(c)] * (p1 > 0)
    return ((p2 * N + p1) * N + c)[ok]


class Models:
    """Log-likelihood ratio, random against ordinary, of each transition.

    Each order backs off to the one below it, with the weight of PRIOR observations; the lowest to an even distribution.
    Random strings are mixed half and half with evenly random ones, so that alphabets that the samples lack count too.
    """

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        self.ratio = np.log(0.5 * self._shares(random) + 0.5 / (N - 1)) - np.log(self._shares(ordinary))

    @staticmethod
    def _shares(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(N, N, N).astype(np.float64)
        p = np.full(N, 1 / (N - 1))
        for part in (c.sum((0, 1)), c.sum(0), c):
            p = (part + PRIOR * p) / (part.sum(-1, keepdims=True) + PRIOR)
        return np.maximum(p, 1e-12).ravel()

    def llrs(self, strings: list[str]) -> np.ndarray:
        """One ratio for each string; all their characters are credential characters."""
        ends = np.cumsum([len(s) for s in strings])
        return np.add.reduceat(self.ratio[transitions([s.encode("ascii") for s in strings])], np.concatenate(([0], ends[:-1])))


def mixed(s: str) -> bool:
    return re.search("[0-9]", s) is not None and re.search("[A-Za-z]", s) is not None


def _unlabelled(s: str) -> bool:
    """Letters and digits in 20 characters, or in 8 without a separator; or case that goes up twice inside."""
    return mixed(s) and (len(s) >= 20 or not re.search("[_=/+-]", s)) or len(re.findall("[a-z][A-Z]", s)) > 1


def _mask(t: str, spans) -> str:
    out, at = [], 0
    for start, _, _, end, _ in spans:
        if end > at:
            part = TAIL.sub("", t[at : max(at, start)])
            out.append(HEAD.sub("", part) if at else part)
            at = end
    return RUN.sub(lambda m: "\n" if _unlabelled(m[0]) else m[0], "\n".join([*out, HEAD.sub("", t[at:]) if at else t]))


def train(docs: DataFrame) -> Models:
    """Models from all documents: counts are summed in each task, then over tasks; 2 * 67**3 numbers at most reach the driver."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros((2, N**3), np.int64)
        for b in batches:
            plain, values, size = [], [], 0
            for t in [*b.column("text").to_pylist(), None]:
                if t:
                    spans = base_spans(t)
                    plain.append(_mask(t, spans).encode("utf-8", "replace"))
                    values += [t[v:e].encode() for _, _, _, e, v in spans]
                    size += len(t)
                if size > 1 << 20 or t is None:
                    for k, part in enumerate((values, plain)):
                        counts[k] += np.bincount(transitions(part), minlength=N**3)
                    plain, values, size = [], [], 0
        k, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[k, at])], names=["label", "step", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, N**3), np.int64)
    counts[got["label"].to_numpy(), got["step"].to_numpy()] = got["n"].to_numpy()
    return Models(counts[0], counts[1])


def _outside(t: str, base) -> list[tuple[int, int]]:
    """(start, end) of the runs of t, with the base spans cut out of them."""
    out, at = [], 0
    for start, end in [*((b[0], b[3]) for b in base), (len(t), len(t))]:
        out += [m.span() for m in RUN.finditer(t, at, max(at, start))]
        at = max(at, end)
    return out


def found_by(models: Models, t: str, base) -> list[tuple[int, int, str, int, int]]:
    """Runs outside the base spans that the random model likes better."""
    runs = _outside(t, base)
    if not runs:
        return []
    each = models.llrs([t[s:e] for s, e in runs])
    return [(s, 3, "random", e, s) for (s, e), x in zip(runs, each.tolist(), strict=True) if x >= MIN_EVIDENCE and x >= MIN_LLR * (e - s)]


def scan(docs: DataFrame, models: Models | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs' keep columns (default: doc_id) with base and extra: arrays of (start, kind, stop, value), sorted; code points, end exclusive.

    Null texts are empty. Repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    models = models or train(docs)
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        item = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32()), ("value", pa.string())]))
        for b in batches:
            rows = [[], []]
            for t in b.column("_text").to_pylist():
                t = t or ""
                base = base_spans(t)
                for out, spans in zip(rows, (base, found_by(shared.value, t, base)), strict=True):
                    out.append([{"start": s, "kind": k, "stop": e, "value": t[v:e]} for s, _, k, e, v in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, item) for x in rows)], names=[*keep, "base", "extra"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kind = "array<struct<start:int,kind:string,stop:int,value:string>>"
    return rows.mapInArrow(run, rows.select(*keep, F.lit(None).cast(kind).alias("base"), F.lit(None).cast(kind).alias("extra")).schema)

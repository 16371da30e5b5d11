"""Token counts without token ids.

Three steps over whole texts: the frequencies of all pre-tokens; the pieces of each distinct pre-token, counted once by
merging; and for each document the sum of pieces times frequency. Pieces of the most frequent pre-tokens go to the tasks,
which sum them at once; the frequencies of all others are joined on the pre-token. No list of ids is made.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, quoted, text_of

FREQUENT = 1 << 17  # pre-tokens whose pieces go to the tasks; the others are joined
SHORT = 24  # bytes of these at most, so that all of them take 4 MB at most
HELD = 1 << 17  # distinct pre-tokens a task gathers before it hands them on
MEMO = 300_000  # chunks a process remembers
TOGETHER = 32  # characters of pre-tokens that are merged together, in arrays
SLICE = 1 << 23  # bytes of text taken at once
#: The normalizer and the pre-tokenizer of the vocabulary that is supported; fixed values of the format.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: PATTERN for lower-cased printable ASCII.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def refuse_others(spec: dict) -> None:
    """Raise on a tokenizer file whose rules this module doesn't have."""
    split, *level = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = spec["model"]
    if (
        spec.get("normalizer") != NORMALIZER or split.get("pattern") != {"Regex": PATTERN} or not split.get("invert") or split.get("behavior") != "Removed" or [x.get("type") for x in level] != ["ByteLevel"] or level[0].get("use_regex", True) or level[0].get("add_prefix_space", True)
        or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "byte_fallback")) or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    ):
        raise ValueError("only lower-casing BPE files with word ends are supported")


class Pieces:
    """Cuts text into pre-tokens, and counts the pieces of a pre-token by merging."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        rules = json.loads(spec)
        refuse_others(rules)
        self.end = rules["model"].get("end_of_word_suffix") or ""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in rules["model"]["merges"]]
        self.rank = {(a, b): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        ids = rules["model"]["vocab"]
        self.n, self.none = len(ids), len(pairs)
        keys = np.array([ids[a] * self.n + ids[b] for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        self.made = np.array([ids.get(a + b, -1) for a, b in pairs], np.int64)  # of each rank
        self.inner, self.final = (np.array([ids.get(chr(c) + e, -1) for c in range(512)], np.int64) for e in ("", self.end))
        names = sorted((t["content"] for t in rules.get("added_tokens", [])), key=lambda s: (-len(s), s))
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.mark = os.path.commonprefix(names)  # stands in every text that holds a special token
        own = Tokenizer.from_str(spec)
        self.normalise, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.memo: dict[str, tuple[list[str], int]] = {}

    def pretokens(self, chunk: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special tokens that stand in it. Unicode rules are the library's."""
        parts = self.special.split(chunk) if self.special and self.mark in chunk else [chunk]
        out: list[str] = []
        for part in parts:
            if part.isascii() and part.isprintable():
                out += _PLAIN.findall(part.lower())
            else:
                out += [p for p, _ in self.cut(self.normalise(part))]
        return out, len(parts) - 1

    def _together(self, chunks: list[str]) -> list[tuple[list[str], int]]:
        """pretokens() of chunks without special tokens, in one call: blanks between them cut as well."""
        text = self.normalise(" ".join(chunks))
        own = text.split(" ")
        if len(own) != len(chunks):  # a chunk holds white space of its own
            return [self.pretokens(c) for c in chunks]
        ends, at = [], 0
        for c in own:
            at += len(c) + 1
            ends.append(at)
        out: list[list[str]] = [[] for _ in chunks]
        k = 0
        for p, (start, _) in self.cut(text):
            while start >= ends[k]:
                k += 1
            out[k].append(p)
        return [(x, 0) for x in out]

    def known(self, chunks: list[str]) -> list[tuple[list[str], int]]:
        """pretokens() of each chunk; short ones are remembered."""
        memo, out, strange = self.memo, [None] * len(chunks), []
        for k, c in enumerate(chunks):
            got = memo.get(c)
            if got is None:
                if c.isascii():
                    got = ([c.lower()], 0) if c.isalpha() else self.pretokens(c)
                    if len(c) <= 64 and len(memo) < MEMO:
                        memo[c] = got
                elif self.mark in c:
                    got = self.pretokens(c)
                else:
                    strange.append(k)
            out[k] = got
        for at in range(0, len(strange), 1000):
            some = strange[at : at + 1000]
            for k, got in zip(some, self._together([chunks[k] for k in some]), strict=True):
                out[k] = got
                if len(chunks[k]) <= 64 and len(memo) < MEMO:
                    memo[chunks[k]] = got
        if len(memo) >= MEMO:
            memo.clear()
        return out

    def count(self, token: str) -> int:
        """Pieces of a pre-token: the lowest-ranked adjacent pair merges, leftmost first, until none is left."""
        part = [*token[:-1], token[-1] + self.end]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        open_, left = [], len(part)

        def see(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (r := self.rank.get((part[i], part[after[i]]))) is not None:
                heapq.heappush(open_, (r, i, part[i], part[after[i]]))

        for i in range(len(part) - 1):
            see(i)
        while open_:
            _, i, a, b = heapq.heappop(open_)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            left -= 1
            see(i)
            see(before[i])
        return left


    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == key), self.ranks[at], self.none)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """count() of each token; of the short ones thousands together, each by its own lowest-ranked pair a step."""
        out = np.array([self.count(t) if len(t) > TOGETHER else 0 for t in tokens], np.int64)
        short = sorted((k for k, t in enumerate(tokens) if len(t) <= TOGETHER), key=lambda k: len(tokens[k]))
        for lo in range(0, len(short), 10_000):
            some = short[lo : lo + 10_000]  # of about one length
            sizes = np.array([len(tokens[k]) for k in some])
            wide, row = int(sizes.max()), np.arange(len(some))
            codes, part = np.frombuffer("".join([tokens[k] for k in some]).encode("utf-32-le"), np.uint32), np.full((len(some), wide), -1)
            part[np.arange(wide) < sizes[:, None]] = self.inner[codes]
            part[row, sizes - 1] = self.final[codes[np.cumsum(sizes) - 1]]
            rank = np.full(part.shape, self.none)  # of the pair that starts here
            rank[:, :-1] = self._rank(part[:, :-1], part[:, 1:])
            live, place = row, np.arange(wide)
            while len(live):
                at = rank[live].argmin(1)
                best = rank[live, at]
                live, at, best = live[best < self.none], at[best < self.none], best[best < self.none]
                shift = np.minimum(place + (place > at[:, None]), wide - 1)
                p, r, i = np.take_along_axis(part[live], shift, 1), np.take_along_axis(rank[live], shift, 1), np.arange(len(live))
                p[:, -1], r[:, -1] = -1, self.none
                p[i, at] = self.made[best]
                after = np.minimum(at + 1, wide - 1)
                r[i, at] = np.where(after > at, self._rank(p[i, at], p[i, after]), self.none)
                before = np.maximum(at - 1, 0)
                r[i, before] = np.where(at > 0, self._rank(p[i, before], p[i, at]), r[i, before])
                part[live], rank[live] = p, r
            out[some] = (part >= 0).sum(1)
        return out


_loaded: dict[str, Pieces] = {}


def load(spec: str) -> Pieces:
    """The rules of a tokenizer file's text, read once a process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(spec)
    return _loaded[key]


def _chunks(texts):
    """Slices of an Arrow string array, of about SLICE bytes: (first, past the last, distinct chunks between ASCII white
    space, the chunk codes of all texts end to end, where each text's begin)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        lists = pc.ascii_split_whitespace(texts.slice(at, upto - at).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        yield at, upto, coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]
        at = upto


def _spec(docs: DataFrame, tokenizer: str):
    """The tokenizer file's text for the tasks: a few MB, of fixed size."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    refuse_others(json.loads(text))
    return docs.sparkSession.sparkContext.broadcast(text)


def pretoken_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(token, n, pieces) of every distinct pre-token of docs' whole texts: how often it stands there, and its pieces."""
    spec = _spec(docs, tokenizer)

    def gather(batches):
        import pyarrow as pa

        rules, found = load(spec.value), Counter()
        show = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])
        for b in batches:
            for _, _, chunks, codes, _ in _chunks(b.column(0)):
                for (tokens, _), n in zip(rules.known(chunks), np.bincount(codes, minlength=len(chunks)).tolist(), strict=True):
                    for token in tokens:
                        found[token] += n
                if len(found) >= HELD:
                    yield show()
                    found.clear()
        yield show()

    def count(batches):
        import pyarrow as pa

        rules = load(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rules.counts(b.column(0).to_pylist()), pa.int64())], names=["token", "n", "pieces"])

    tokens = docs.select(text_of().alias("text")).mapInArrow(gather, "token string, n long")
    return tokens.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(count, "token string, n long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str, keep: list[str], limit: int = 2048) -> DataFrame:
    """docs' keep columns with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of each whole text;
    beside a kept column of one of these names, with _ before it.

    Null and empty texts have no tokens. Strings of special tokens in a text count as one token each. Very long texts are
    counted whole. Repeated rows stay, null ids too; an empty table gives no rows; other columns, of whatever name, are
    left out. A pre-token shared by all documents is summed inside the tasks, so that no join key is hot.
    """
    scratch, spec = Scratch(docs.sparkSession), _spec(docs, tokenizer)
    pieces = scratch.keep(pretoken_counts(docs, tokenizer), "pieces")
    top = pieces.where(F.octet_length("token") <= SHORT).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token", "pieces").toArrow()
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["pieces"].to_pylist(), strict=True)))
    own = [f"kept_{k}" for k in range(len(keep))]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        rules, of = load(spec.value), frequent.value
        shape = pa.struct([("token", pa.string()), ("n", pa.int64())])
        for b in batches:
            texts = b.column(len(keep) + 1)
            for lo, hi, chunks, codes, starts in _chunks(texts):
                # what the frequent pre-tokens and special tokens of each chunk come to, and its other pre-tokens
                sums, owner, others, known = np.zeros(len(chunks), np.int64), [], [], {}
                for k, (tokens, n) in enumerate(rules.known(chunks)):
                    for t in tokens:
                        if (p := of.get(t)) is None:
                            owner.append(k)
                            others.append(known.setdefault(t, len(known)))
                        else:
                            n += p
                    sums[k] = n
                totals = np.concatenate(([0], np.cumsum(sums[codes])))[starts]
                # (text, other pre-token) with its frequency
                per = np.bincount(np.array(owner, np.int64), minlength=len(chunks))
                first = np.cumsum(per) - per
                at = np.flatnonzero(per[codes])
                n = per[codes[at]]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                token = np.array(others, np.int64)[np.repeat(first[codes[at]], n) + inside]
                where = np.repeat(np.searchsorted(starts, at, "right") - 1, n)
                pair, freq = np.unique(where * max(1, len(known)) + token, return_counts=True)
                bounds = np.searchsorted(pair // max(1, len(known)), np.arange(hi - lo + 1))
                held = pa.StructArray.from_arrays([pa.array(list(known), pa.string()).take(pa.array(pair % max(1, len(known)))), pa.array(freq, pa.int64())], fields=list(shape))
                out = [pc.binary_length(texts.slice(lo, hi - lo)).cast(pa.int64()), pa.array(np.diff(totals), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), held)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(len(keep) + 1)), *out], names=["row", *own, "n_bytes", "n_tokens", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *(quoted(c).alias(k) for c, k in zip(keep, own, strict=True)), text_of().alias("text"))
    shape = rows.select("row", *own, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("array<struct<token:string,n:bigint>>").alias("rare")).schema
    rows = scratch.keep(rows.mapInArrow(run, shape), "rows")  # the row numbers hold once they are written
    rest = rows.select("row", F.inline("rare")).join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("n_tokens") + F.coalesce(F.col("more"), F.lit(0))
    names = [free_name(c, keep) for c in ("n_bytes", "n_tokens", "over_limit")]
    counted = rows.drop("rare").join(rest, "row", "left")
    return counted.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), *(c.alias(n) for c, n in zip((F.col("n_bytes"), total, total > limit), names, strict=True)))

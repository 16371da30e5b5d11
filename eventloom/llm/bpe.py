"""Byte-pair encoding by speculation and verification, and decoding.

Texts are cut by the pre-tokenizer's pattern; each new piece is encoded once a task. For all new pieces of a batch at
once, greedy longest match proposes tokens. A proposal is the exact encoding if and only if each adjacent pair of its
tokens is compatible: merging the bytes of the two by rank gives these two tokens again. That is checked for all pairs
together in numpy. Only pieces with an incompatible pair go through exact merging.

A pair is compatible if no merge across its boundary comes before the merges that formed the tokens on either side. The
check walks back through those merges, latest first, and looks up the merge of the two parts then at the boundary.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, quoted

#: The pre-tokenizer's pattern of the byte-level vocabularies; a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 100_000  # pieces, and chunks, remembered by a process
#: A chunk: white space with what follows it up to the next white space. No piece crosses into another chunk.
_CHUNK = regex.compile(r"\s*\S+|\s+", regex.VERSION0)
#: White space for Arrow's search; more of it than the pattern's \s only sends a text the longer way.
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank or line end after white space and before white space or the end: here alone, cutting before it splits a piece.
_UNEVEN = rf"{_WHITE}[ \n](?:{_WHITE}|\z)"
_CUT = "\ue000"  # stands at the cuts; texts that hold it are cut one by one
SHORT = 32  # bytes of pieces that are proposed and merged together, in arrays


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(spec: dict) -> None:
    """Raise on a tokenizer file that PATTERN and plain merging don't describe."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [
        pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True),
        spec.get("normalizer"), model.get("type", "BPE") != "BPE", *(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")),
        any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")),
    ]
    if any(odd):
        raise ValueError("only byte-level BPE files with the standard pre-tokenizer and no normalizer are supported")


class Vocabulary:
    """Tokens by id, merges by rank, and the tables of the pair check."""

    def __init__(self, spec: dict):
        refuse_others(spec)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.ids = ids
        self.bytes = [b""] * n
        for b, i in ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank = np.full(n, -1, np.int64)  # rank of the merge that forms a token; -1: a byte
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys, made = [], []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            i, j, k = ids[a], ids[b], ids[a + b]
            self.merge[i, j] = (r, k)
            keys.append(i * n + j)
            made.append(r)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        order = np.argsort(keys)
        self.keys, self.made, self.n = np.array(keys, np.int64)[order], np.array(made, np.int64)[order], n
        self.longest = max(map(len, ids))
        self.merged_id = np.array([self.merge[int(k) // n, int(k) % n][1] for k in self.keys], np.int64)
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        # proposals use tokens that merging can reach from bytes alone
        known = list(ids)
        self.reachable = {b: ids[b] for b, got in zip(known, self.exact_all(known), strict=True) if got == [ids[b]]}
        steps: dict[tuple[int, int], int] = {}
        self.token_at = [-1]  # of each node of the prefix tree of these tokens: the token that ends there
        for b, i in self.reachable.items():
            node = 0
            for x in b:
                if (node, x) not in steps:
                    steps[node, x] = len(self.token_at)
                    self.token_at.append(-1)
                node = steps[node, x]
            self.token_at[node] = i
        self.token_at = np.array(self.token_at, np.int64)
        step, to = np.array([a * 256 + x for a, x in steps], np.int64), np.array(list(steps.values()), np.int64)
        order = np.argsort(step)
        self.step, self.to = step[order], to[order]

    def exact(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left. Long pieces use a heap."""
        import heapq

        part = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(len(part) - 1) if (m := self.merge.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], nxt[i] = self.merge[a, b][1], -1, nxt[j]
            if nxt[j] < len(part):
                prv[nxt[j]] = i
                if m := self.merge.get((part[i], part[nxt[j]])):
                    heapq.heappush(heap, (m[0], i, part[i], part[nxt[j]]))
            if prv[i] >= 0 and (m := self.merge.get((part[prv[i]], part[i]))):
                heapq.heappush(heap, (m[0], prv[i], part[prv[i]], part[i]))
        return [p for p in part if p >= 0]

    def greedy(self, piece: bytes) -> list[int]:
        out, at, ids, longest = [], 0, self.reachable, self.longest
        while at < len(piece):
            for end in range(min(len(piece), at + longest), at, -1):
                i = ids.get(piece[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def propose(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of pieces of 1 to SHORT bytes: (piece, token) of each, in order. All pieces walk the prefix tree at once, a byte a step."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, ends = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(sizes)
        live = np.arange(len(pieces))
        start = ends - sizes
        at, node, upto, best = start.copy(), np.zeros(len(pieces), np.int64), start.copy(), np.full(len(pieces), -1)
        out = []
        while len(live):
            x = at[live]
            key = node[live] * 256 + data[np.minimum(x, len(data) - 1)]
            k = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            ok = (x < ends[live]) & (self.step[k] == key)
            go, to = live[ok], self.to[k[ok]]
            node[go] = to
            at[go] += 1
            token = self.token_at[to]
            hit, token = go[token >= 0], token[token >= 0]
            upto[hit], best[hit] = at[hit], token
            done = live[~ok]
            out.append((done, start[done], best[done]))
            start[done] = at[done] = upto[done]
            node[done] = 0
            live = live[ok | (upto[live] < ends[live])]
        of, where, token = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(where)
        return of[order], token[order]

    def exact_all(self, pieces: list[bytes]) -> list[list[int]]:
        """exact() of each piece; short ones together, each by its own lowest-ranked pair a step."""
        out: list = [self.exact(p) if len(p) > SHORT else [] for p in pieces]
        short = sorted((i for i, p in enumerate(pieces) if 0 < len(p) <= SHORT), key=lambda i: len(pieces[i]))
        for lo in range(0, len(short), 10_000):
            some = short[lo : lo + 10_000]  # of about one length
            sizes = np.array([len(pieces[i]) for i in some])
            wide = int(sizes.max())
            inside = np.arange(wide) < sizes[:, None]
            part = np.full(inside.shape, -1, np.int64)
            part[inside] = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            none = len(self.keys)
            rank = np.full(inside.shape, none, np.int64)  # of the pair that starts here
            rank[:, :-1] = np.where(inside[:, 1:], self._merged(part[:, :-1], part[:, 1:]), none)
            live, place = np.arange(len(some)), np.arange(wide)
            while len(live):
                j = rank[live].argmin(1)
                found = rank[live, j] < none
                live, j = live[found], j[found]
                if not len(live):
                    break
                row, a, r = np.arange(len(live)), part[live], rank[live]
                new = self.merged_id[np.searchsorted(self.keys, a[row, j] * self.n + a[row, np.minimum(j + 1, wide - 1)])]
                shift = np.minimum(place + (place > j[:, None]), wide - 1)
                a, r = np.take_along_axis(a, shift, 1), np.take_along_axis(r, shift, 1)
                a[:, -1], r[:, -1] = -1, none
                a[row, j] = new
                for at, there in ((j, np.ones(len(j), bool)), (j - 1, j > 0)):
                    x, y = a[row, np.maximum(at, 0)], a[row, np.minimum(at + 1, wide - 1)]
                    there = there & (y >= 0) & (at + 1 < wide)
                    r[row[there], at[there]] = self._merged(x[there], y[there])
                    gone = ~there & (at >= 0)
                    r[row[gone], at[gone]] = none
                part[live], rank[live] = a, r
            for i, ids, size in zip(some, part.tolist(), (part >= 0).sum(1).tolist(), strict=True):
                out[i] = ids[:size]
        return out

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; beyond all ranks without one."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], len(self.keys))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of tokens, which are left alone by merging."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        # the parts at the boundary exist before rank `until`, when they were merged into what holds them
        until = np.full(len(a), len(self.keys), np.int64)
        until_a, until_b = until.copy(), until.copy()
        while len(live):
            x, y = a[live], b[live]
            r = self._merged(x, y)
            ua, ub = until_a[live], until_b[live]
            # of equal ranks the leftmost merge comes first: the left neighbour's merge wins, then the boundary's
            bad = (r < ua) & (r <= ub) & (r < len(self.keys))
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, rx, ry, x, y = live[go], rx[go], ry[go], x[go], y[go]
            back_a = rx > ry
            back_b = ~back_a
            i, j = live[back_a], live[back_b]
            until_a[i], a[i] = rx[back_a], self.right[x[back_a]]
            until_b[j], b[j] = ry[back_b], self.left[y[back_b]]
        return ok

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact token ids of each piece."""
        if not pieces:
            return []
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= SHORT]
        of, flat = self.propose([pieces[i] for i in short]) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of = np.array(short, np.int64)[of]
        long = [(i, self.greedy(p)) for i, p in enumerate(pieces) if len(p) > SHORT]
        of = np.concatenate([of, np.repeat([i for i, _ in long], [len(x) for _, x in long]).astype(np.int64)])
        flat = np.concatenate([flat, np.array([t for _, x in long for t in x], np.int64)])
        wrong = np.zeros(len(pieces), bool)
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
            ok = self.compatible(pairs // self.n, pairs % self.n)
            wrong[of[inner[~ok[back]]]] = True
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        tokens, out = flat.tolist(), [[] for _ in pieces]
        for i, lo, hi in zip(of[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(tokens)], strict=True):
            out[i] = tokens[lo:hi]
        failed = np.flatnonzero(wrong).tolist()
        for i, ids in zip(failed, self.exact_all([pieces[i] for i in failed]), strict=True):
            out[i] = ids
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", errors="replace")


class Encoder:
    """Encodes texts; remembers pieces, and of short chunks the digits of their ids and their decoded bytes."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.memo, self.shown = vocab, {}, {}
        self.digits = [f",{i}".encode() for i in range(vocab.n)]
        self.cut = regex.compile(PATTERN)
        names = sorted(vocab.special, key=lambda s: (-len(s), s))
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.v.special):
            return self.cut.findall(text)
        return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else self.cut.findall(part))]

    def learn(self, cut: list[list[str]]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [p for p in {p for ps in cut for p in ps} if p not in self.memo]
        for s in self.v.special:
            if s in new:
                new.remove(s)
                self.memo[s] = [self.v.special[s]]
        for p, ids in zip(new, self.v.encode([p.encode() for p in new]), strict=True):
            self.memo[p] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t or "") for t in texts]
        self.learn(cut)
        return [[i for p in ps for i in self.memo[p]] for ps in cut]

    def table(self, chunks: list[str], special: bool) -> tuple:
        """Of each chunk: the number of its ids, the ids in digits with a comma before each, and the bytes they decode to."""
        import pyarrow as pa

        if len(self.shown) > MEMO:
            self.shown.clear()
        new = [c for c in set(chunks) if c not in self.shown]
        pieces = [self.pieces(c) for c in new] if special else list(map(self.cut.findall, new))
        self.learn(pieces)
        memo, raw, digits, long = self.memo, self.v.bytes, self.digits, {}
        for c, ps in zip(new, pieces, strict=True):
            ids = memo[ps[0]] if len(ps) == 1 else [i for p in ps for i in memo[p]]
            (self.shown if len(c) <= LONG else long)[c] = (len(ids), b"".join([digits[i] for i in ids]), b"".join([raw[i] for i in ids]))
        got = [self.shown.get(c) or long[c] for c in chunks]
        return np.array([x[0] for x in got], np.int64), *(pa.array([x[k] for x in got], pa.large_binary()) for k in (1, 2))

    def _of_codes(self, chunks: list[str], codes: np.ndarray, firsts: np.ndarray, special: bool) -> list[tuple[int, str, str]]:
        """digests() of texts that are chunks[codes], each from its first to before the next one's."""
        counts, digits, decoded = self.table(chunks, special)
        n = np.add.reduceat(counts[codes], firsts).tolist()
        bounds, sums = np.append(firsts, len(codes)), []
        for parts, skip in ((digits, 1), (decoded, 0)):
            parts = parts.take(codes)  # end to end in one buffer
            at = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1][bounds].tolist()
            data = memoryview(parts.buffers()[2] or b"")
            # chunks are whole characters, and exact ids decode to their bytes: what is hashed is valid UTF-8
            sums.append([hashlib.sha256(data[min(lo + skip, hi) : hi]).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)])
        return list(zip(n, *sums, strict=True))

    def digests(self, texts) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of an Arrow array of texts without nulls.

        A text is cut before each blank and line end, and equal chunks of all texts are encoded once; uneven texts and
        those with special tokens are cut one by one.
        """
        import pyarrow.compute as pc

        holds = lambda s: pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduce([np.zeros(len(texts), bool), *map(holds, self.v.special)])
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) | holds(_CUT) | whole
        out: list = [None] * len(texts)
        even, odd = np.flatnonzero(~uneven), np.flatnonzero(uneven)
        if len(even):
            marked = pc.replace_substring(pc.replace_substring(texts.take(even), " ", f"{_CUT} "), "\n", f"{_CUT}\n")
            lists = pc.split_pattern(marked, _CUT)
            coded = lists.flatten().dictionary_encode()
            got = self._of_codes(coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()[:-1], False)
            for i, x in zip(even.tolist(), got, strict=True):
                out[i] = x
        if len(odd):
            cut = [[t] if w else _CHUNK.findall(t) for t, w in zip(texts.take(odd).to_pylist(), whole[odd].tolist(), strict=True)]
            known = {c: k for k, c in enumerate(dict.fromkeys(c for cs in cut for c in cs))}
            codes = np.array([known[c] for cs in cut for c in cs], np.int64)
            firsts = np.cumsum([0, *map(len, cut[:-1])])
            for i, x in zip(odd.tolist(), self._of_codes(list(known), codes, firsts, True), strict=True):
                out[i] = x
        return out


CHUNK = 1 << 21  # bytes encoded at once
LONG = 64  # longer chunks are not remembered
_loaded: dict[str, Encoder] = {}


def load(spec: str) -> Encoder:
    """The encoder of a tokenizer file's text, made once a process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(json.loads(spec)))
    return _loaded[key]


def _spec(spark: SparkSession, tokenizer: str):
    """The tokenizer file's text for the tasks: a few MB, of fixed size."""
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    refuse_others(json.loads(text))
    return spark.sparkContext.broadcast(text)


def _slices(texts):
    """(from, to) of parts of an Arrow string array, of about CHUNK bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, upto
        at = upto


def tokenise(docs: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """docs' keep columns (default: all; one named ids is replaced) with ids (array<int>), for training; tokenizer is the path of a byte-level BPE file. Null texts give an empty array."""
    keep = [c for c in keep or docs.columns if c.lower() != "ids"]
    spec = _spec(docs.sparkSession, tokenizer)

    def run(batches):
        import pyarrow as pa

        enc = load(spec.value)
        for b in batches:
            texts = b.column(len(keep))
            for lo, hi in _slices(texts):
                ids = pa.array(enc.encode(texts.slice(lo, hi - lo).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(len(keep))), ids], names=[*keep, "ids"])

    rows = docs.select(*map(quoted, keep), F.col("text").cast("string").alias(free_name("text", keep)))
    return rows.mapInArrow(run, rows.select(*map(quoted, keep), F.lit(None).cast("array<int>").alias("ids")).schema)


def detokenise(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows with ids replaced by text (one that is there goes): bytes of the tokens as UTF-8, broken sequences as U+FFFD. Null ids give an empty text."""
    keep = [c for c in rows.columns if c.lower() not in ("ids", "text")]
    spec = _spec(rows.sparkSession, tokenizer)

    def run(batches):
        import pyarrow as pa

        v = load(spec.value).v
        for b in batches:
            texts = pa.array([v.decode(x or []) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), texts], names=[*keep, "text"])

    return rows.select(*map(quoted, keep), "ids").mapInArrow(run, rows.select(*map(quoted, keep), F.lit(None).cast("string").alias("text")).schema)


def digests(docs: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """docs' keep columns with n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again in one pass.

    Null texts are empty: no tokens, digests of the empty text. Special tokens that stand in a text are encoded as such.
    Very long texts are encoded whole. Repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    spec = _spec(docs.sparkSession, tokenizer)

    def run(batches):
        import gc

        import pyarrow as pa

        gc.disable()  # nothing here makes cycles, and the collector would walk all that is remembered again and again
        try:
            enc = load(spec.value)
            for b in batches:
                texts = b.column(len(keep))
                for lo, hi in _slices(texts):
                    n, ids, back = zip(*enc.digests(texts.slice(lo, hi - lo).cast(pa.large_string()).fill_null("")), strict=True)
                    out = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(len(keep))), *out], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()  # the process runs other tasks after this one

    rows = docs.select(*map(quoted, keep), F.col("text").cast("string").alias(free_name("text", keep)))
    shape = rows.select(*map(quoted, keep), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return rows.mapInArrow(run, shape)

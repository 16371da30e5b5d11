"""Shared pieces of the corpus operators: tables, scratch space, native text expressions, numpy shingling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: blank and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In a local session without one (tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return sc.getCheckpointDir()


class Scratch:
    """Written tables in the shared folder. They cut lineage, survive lost executors, and go when dropped or when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        fs, p = self._fs(self.at)
        fs.deleteOnExit(p)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(f"{self.at}/{name}")
            fs.delete(p, True)


def free_name(name: str, taken: list[str]) -> str:
    """name, or one made from it that none of taken has in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(c: Column) -> Column:
    """c, evaluated once a row where it stands: the optimizer neither copies it into lambdas or filters that use it nor
    pushes those below it. The condition always holds; an expression with a row counter in it may not be duplicated."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def n_words_of(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def crc_mod5(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


# numpy shingling, inside tasks

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)  # a random 64-bit value for each byte
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 8, dtype=np.uint64) | _U(1)  # odd multipliers of the words of a shingle
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SEGMENT = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    with np.errstate(over="ignore"):
        x = x ^ _U(salt)
        x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
        x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
        return x ^ (x >> _U(33))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max([1 << max(20, int(n).bit_length()), *_powers])
    if size not in _powers:
        _powers.clear()
        inv = _U(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            one = lambda b: np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, b, np.uint64))))
            _powers[size] = one(_BASE), one(inv)
    return _powers[size]


def _word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of raw (bytes of whole texts laid end to end), and the number of words before each bound."""
    b = _FOLD[raw]
    full = ~_SPACE[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], full[:-1])) & ~cut[:-1]
    starts = np.flatnonzero(full & ~before)
    after = np.concatenate((full[1:], [False])) & ~cut[1:]
    ends = np.flatnonzero(full & ~after) + 1
    up, down = _pow(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([_U(0)], np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)))
        h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def _long_word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of one long text's words, by segments that end at white space."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + SEGMENT)
        out.append(_word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word windows; with fewer words, of the whole sequence; none without words."""
    m = len(words)
    if not m:
        return words
    k = min(size, m)
    with np.errstate(over="ignore"):
        h = np.full(m - k + 1, _U(k), np.uint64)
        for j in range(k):
            h = h + words[j : m - k + 1 + j] * _STEP[j]
    return np.unique(mix(h))


def each_set(texts, size: int = 5):
    """texts: an Arrow string array. Yields its index and shingle set, in order; nulls are empty."""
    import pyarrow as pa

    for at in range(0, len(texts), 256):
        part = texts.slice(at, 256).cast(pa.large_string()).fill_null("")
        part = pa.concat_arrays([part])  # an own buffer that starts at 0
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(part):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1)
            lo, hi = offsets[first], offsets[last]
            if last == first + 1 and hi - lo > SEGMENT:
                yield at + first, shingles(_long_word_hashes(data[lo:hi]), size)
            else:
                h, counts = _word_hashes(data[lo:hi], offsets[first : last + 1] - lo)
                for i in range(last - first):
                    yield at + first + i, shingles(h[counts[i] : counts[i + 1]], size)
            first = last

"""Shared helpers of the text operators: table access, whole-batch tokenising, hashing."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python class of the six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]"
#: Text bytes that one inner step of a Python task holds at once.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def drawn(df: DataFrame, rows: int, *of: str) -> DataFrame:
    """At most `rows` rows of df: those with the smallest hash of the given columns (of equal hashes, any).

    The share of the hashes' range that holds so many rows is known from their number, so that only a few more than `rows`
    hashes are ranked; no task gets the candidates of all others, and none gives its candidates' texts away.
    """
    h = F.xxhash64(*of)
    n = df.count()
    share = (rows + 8 * rows**0.5 + 16) / max(1, n)
    while True:
        low = df.select(h.alias("h"))
        if share < 1:
            low = low.filter(F.col("h") < F.lit(-(1 << 63) + int(share * (1 << 64))))
        top, got = low.orderBy("h").limit(rows).agg(F.max("h"), F.count("*")).first()
        if got >= min(rows, n) or share >= 1:
            return df.filter(h <= F.lit(top)).limit(rows)
        share *= 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text (a longer text alone)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work as the function of a task, at whose end memory that was freed goes back to the system.

    Python workers are kept for later tasks, and live on idle beside those that need no Python.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _powers.cache.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return task


class Kept:
    """Results by key in two generations of at most `most`: when the younger is full the older one is let go.

    Results that are looked up move to the younger generation, so that frequent keys stay.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys without a result; all others are in the younger generation afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        back = new.intersection(self.old)
        self.young.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return new - back


def raw(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a common integer hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 0xD6E8FEB86659FD93
_INVERSE = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on: n numbers, kept until the task ends."""
    cache = _powers.cache
    if len(cache.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        cache[base] = np.multiply.accumulate(out)
    return cache[base][:n]


_powers.cache = {}


class Words:
    """The words of several texts, found and hashed at once.

    member: 256 flags, which bytes belong to words. Attributes: buf (bytes of all texts, ASCII lower-cased on request,
    a separator after each), start and end of each word in buf, doc (index of its text), hash (64 bits of its bytes).
    """

    def __init__(self, texts: list[bytes], member: np.ndarray, lower: bool = True, hashes: bool = True):
        whole = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(whole.lower() if lower else whole, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_end = np.cumsum(sizes)
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inside[1:-1] = member[self.buf]
        inside[self.text_end] = 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.text_end, self.start, side="right")
        self.hash = self.hashed(self.start, self.end) if hashes else None

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each word, taken over stretches of about STEP_BYTES, so that a long text needs no more."""
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(start, base + STEP_BYTES)))
            n = int(end[j - 1] - base)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.buf[base : base + n]] * _powers(_STEP, n), out=sums[1:])
            a, b = start[i:j] - base, end[i:j] - base
            out[i:j] = mixed((sums[b] - sums[a]) * _powers(_INVERSE, n + 1)[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.text_end))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def members(*outside: tuple[int, int]) -> np.ndarray:
    """Flags of the bytes that are in none of the given ranges (both ends included)."""
    out = np.ones(256, dtype=np.int8)
    for a, b in outside:
        out[a : b + 1] = 0
    return out


#: Words between white space; words of letters, digits and all beyond ASCII.
SPACED = members((0x20, 0x20), (0x09, 0x0D))
PLAIN = members((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))



"""Hard-negative mining by Four-Russians scoring: subset sums of the anchors, looked up by bytes of the candidates' bits.

The components of a vector become whole numbers. For every eight dimensions of an anchor a table holds the sums of its
components over all 256 subsets of the eight. A candidate is kept as bit planes: bit i of eight components is one byte, and
the last plane, the sign, counts negative (two's complement). The inner product is then the sum over planes of
2**i times the looked-up sums of the plane's bytes: whole scores, exact, without a multiplication by a component.

All anchors meet all candidates in a grid of blocks: candidates are dealt to blocks of about CANDIDATES rows and anchors to
blocks of about ANCHORS, a task takes one block of each, and of its scores only the first few of each anchor leave it. Two
passes: the first finds each anchor's positives, the second holds each candidate against their scores.

Defined results: rows with a null label, a null vector, or a component that is null or not finite take no part; a shorter
vector counts as filled up with zeros. Repeated rows (same id, label and numbers) count once; a row with the same id as an
anchor is never its positive. Rows without an id are no anchors; they come last of equal scores. An anchor without a positive
gives no rows, a positive without a negative in its range neither; an empty table gives an empty result. Scores are longs
and wrap as they do if components are so large that a score doesn't fit. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.llm.common import lean
from cutoffs.session import materialize

#: Rows of a block on either side. A candidate moves once for each block of anchors, with a byte for eight dimensions of a plane.
ANCHORS, CANDIDATES = 4096, 4096
#: Anchors whose tables a task holds at once, and candidates that meet them at once.
TABLES, MEET = 64, 2048
SUBSETS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, v): distinct rows that take part, with components floor(scale * x)."""
    x = F.col(vector_col)
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    df = rows.select(F.col(id_col).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.when(whole, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))).alias("v"))
    return df.dropna(subset=["label", "v"]).dropDuplicates(["id", "label", "v"])


def bit_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers (rows, 8 * groups) in two's complement; bit d of a byte is dimension d of its group."""
    out = np.empty((len(v), planes, v.shape[1] // 8), dtype=np.uint8)
    for i in range(planes):
        bits = ((v >> np.int64(i)) & 1).astype(np.uint8)
        out[:, i, :] = np.packbits(bits.reshape(len(v), -1, 8), axis=2, bitorder="little")[:, :, 0]
    return out


def subset_sums(a: np.ndarray) -> np.ndarray:
    """(anchors, groups, 256): the sums of each group of eight components over all subsets."""
    return np.stack([a[:, g : g + 8] @ SUBSETS.T.astype(a.dtype) for g in range(0, a.shape[1], 8)], axis=1)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates): the exact inner products, by look-ups that are shifted and added."""
    n = planes.shape[1]
    out = np.zeros((len(tables), len(planes)), dtype=tables.dtype)
    for i in range(n):
        part = np.take(tables[:, 0], planes[:, i, 0], axis=1)
        for g in range(1, tables.shape[1]):
            part += np.take(tables[:, g], planes[:, i, g], axis=1)
        part <<= tables.dtype.type(i)
        if i == n - 1:
            out -= part
        else:
            out += part
    return out


def _matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists of a column as rows of equal width, filled up with zeros."""
    a = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if (np.diff(a.offsets.to_numpy()) == width).all():
        return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    out = np.zeros((len(a), width), dtype=np.int64)
    for i, x in enumerate(a.to_pylist()):
        out[i, : len(x)] = x
    return out


def _packed(batches: Iterator[pa.RecordBatch], dims: int, planes: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) with the bytes of their bit planes in place of v."""
    for batch in batches:
        bits = bit_planes(_matrix(batch.column(2), dims), planes).reshape(batch.num_rows, planes * dims // 8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "label", "bits"])


def _grid(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, anchors: int, candidates: int) -> DataFrame:
    """work for each pair of a block of left (anchors) and a block of right (candidates)."""
    na, nc = max(1, -(-left.count() // anchors)), max(1, -(-right.count() // candidates))
    block = lambda n, name, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = left.select("*", block(na, "ba", "row"), every(nc, "bc"))
    c = right.select("*", block(nc, "bc", "id", "label", "bits"), every(na, "ba"))
    return a.groupBy("ba", "bc").cogroup(c.groupBy("ba", "bc")).applyInArrow(lambda x, y: work(x, y), schema)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest scores, ties by smaller id; ids must be in order."""
    if len(score) > n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= least)  # all that tie with the last
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")][:n]


def _scored(x: pa.Table, y: pa.Table, dims: int, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in x, its scores with all rows of y) for each anchor of x."""
    a = _matrix(x["v"], dims)
    small = dims * int(np.abs(a).max(initial=0)) << planes < 1 << 31  # then look-ups of half the width are exact
    a = a.astype(np.int32) if small else a
    bits = np.frombuffer(b"".join(y["bits"].to_pylist()), dtype=np.uint8).reshape(len(y), planes, dims // 8)
    for i in range(0, len(a), TABLES):
        tables = subset_sums(a[i : i + TABLES])
        parts = [scores(tables, bits[j : j + MEET]) for j in range(0, len(bits), MEET)]
        for k, row in enumerate(np.concatenate(parts, axis=1).astype(np.int64)):
            yield i + k, row


def _ordered(y: pa.Table) -> pa.Table:
    return y.sort_by([("id", "ascending")])  # nulls come last


def _positives(x: pa.Table, y: pa.Table, dims: int, planes: int, most: int) -> pa.Table:
    out: list[tuple] = []
    if len(x) and len(y):
        y = _ordered(y)
        ids, known, label = y["id"].fill_null(0).to_numpy(), y["id"].is_valid().to_numpy(), y["label"].to_numpy()
        mine, row, own = x["id"].to_numpy(), x["row"].to_numpy(), x["label"].to_numpy()
        for i, score in _scored(x, y, dims, planes):
            at = np.flatnonzero((label == own[i]) & ~(known & (ids == mine[i])))
            at = at[_first(score[at], ids[at], most)]
            out += [(row[i], mine[i], ids[j] if known[j] else None, score[j]) for j in at]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["row", "anchor_id", "positive_id", "positive_score"])


def _negatives(x: pa.Table, y: pa.Table, dims: int, planes: int, most: int, low: int, high: int) -> pa.Table:
    out: list[tuple] = []
    if len(x) and len(y):
        y = _ordered(y)
        ids, known, label = y["id"].fill_null(0).to_numpy(), y["id"].is_valid().to_numpy(), y["label"].to_numpy()
        row, own, goals = x["row"].to_numpy(), x["label"].to_numpy(), x["goals"].to_pylist()
        for i, score in _scored(x, y, dims, planes):
            other = np.flatnonzero(label != own[i])
            theirs = score[other]
            for rank, goal in enumerate(goals[i]):
                at = other[(theirs >= -(-low * goal // 100)) & (theirs <= high * goal // 100)]
                at = at[_first(score[at], ids[at], most)]
                out += [(row[i], rank, ids[j] if known[j] else None, score[j]) for j in at]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["row", "place", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors: int = ANCHORS, candidates: int = CANDIDATES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and positive.

    rows: (id, label, v) of `vectors`; is_anchor tells the anchors (of those with an id). A positive is one of the first
    `positives` other rows with the anchor's label; its negatives are the first `negatives` rows with another label whose
    score is low to high hundredths of the positive's.
    """
    rows = materialize(rows)
    size, top, bottom = (x or 0 for x in rows.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first())
    dims = -(-max(1, size) // 8) * 8
    planes = max(top.bit_length(), (~bottom).bit_length() if bottom < 0 else 0) + 1
    right = materialize(rows.mapInArrow(lean(lambda it: _packed(it, dims, planes)), "id bigint, label bigint, bits binary"))
    # a row's own number keeps anchors of one id apart
    left = materialize(rows.filter(is_anchor & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()))

    def rank(keys: list[str], score: str, name: str) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(name)))

    found = _grid(left, right, lambda x, y: _positives(x, y, dims, planes, positives), "row bigint, anchor_id bigint, positive_id bigint, positive_score bigint", anchors, candidates)
    goal = materialize(found.withColumn("place", rank(["row"], "positive_score", "positive_id") - 1).filter(F.col("place") < positives))
    # a list has `positives` scores at most
    goals = goal.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("goals"))
    met = _grid(materialize(left.join(goals, "row")), right, lambda x, y: _negatives(x, y, dims, planes, negatives, low, high), "row bigint, place int, negative_id bigint, negative_score bigint", anchors, candidates)
    best = met.withColumn("rank", rank(["row", "place"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return best.join(goal, ["row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

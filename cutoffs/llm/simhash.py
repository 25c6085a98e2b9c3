"""SimHash near-duplicates: fingerprints, pigeonhole block join, components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows each get
their row back; an empty table gives an empty result; a null id takes part in links but never names a component unless
the whole component has no other id (then null). Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutoffs.contraction import connected_components
from cutoffs.llm.common import lean, raw, steps
from cutoffs.session import materialize

SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one lower-cased text."""
    parts = text.split()
    if not parts:
        return 0
    line = b" ".join(parts)
    end = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    k = min(words, len(parts))
    start = np.concatenate(([0], end[:-1] + 1))[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(start, end[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            fps = np.array([fingerprint(t.lower(), words) for t in raw(part.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp BIGINT) for each row: a bit is set if over half of the shingle hashes have it set."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(lambda it: _fingerprints(it, words)), f"doc_id {kind}, fp bigint")


def block_masks(blocks: int, agree: int) -> list[int]:
    """Bit masks (as signed 64-bit values) of every choice of `agree` out of `blocks` even parts of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _blocks_for(n: int, bits: int) -> int:
    """So many blocks that few unrelated fingerprints share a key: keys get longer as the table grows."""
    for blocks in range(bits + 1, bits + 5):
        if 64 * n <= 2 ** (64 * (blocks - bits) // blocks):
            return blocks
    return bits + 4


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Enough links (a, b) between fingerprints at most `bits` apart to give all connected components.

    nodes: distinct fingerprints (fp, n documents). Pairs that differ in at most `bits` bits agree in at least
    blocks - bits of the blocks. In each group of a block key all members are first compared with two hubs; what these
    links join needs no more comparing, so that a group of thousands of near copies is linked as a star and not by all
    its pairs. Members outside the hub's component are then compared with the whole group, which finds the rest.

    A plan knows of nodes' rows but not that each becomes many keys, and takes the groups for small: joins are told not to
    broadcast them.
    """
    n = nodes.count()
    blocks = _blocks_for(n, bits)
    masks = block_masks(blocks, blocks - bits)
    # small rows that become 35 keys and more each: spread before they do
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = spread.select("fp", "n", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("k", "mask"))
    keyed = keyed.select("fp", "n", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    groups = keyed.groupBy("k", "key").agg(F.count("*").alias("size"), F.max(F.struct("n", "fp")).getField("fp").alias("hub"), F.min("fp").alias("low")).filter("size > 1")
    member = materialize(keyed.join(groups.hint("merge"), ["k", "key"]).select("k", "key", "fp", "hub", "low"))
    star = member.select("fp", F.explode(F.array("hub", "low")).alias("to")).filter((F.col("fp") != F.col("to")) & (distance("fp", "to") <= bits)).select(F.least("fp", "to").alias("a"), F.greatest("fp", "to").alias("b")).distinct()
    star = materialize(star)
    comp = connected_components(star, "a", "b").withColumnRenamed("node", "fp")
    at = materialize(member.join(comp.hint("merge"), "fp", "left").select("k", "key", "fp", "hub", F.coalesce("component", "fp").alias("c")))
    lead = at.filter("fp = hub").select("k", "key", F.col("c").alias("hub_c"))
    # a group whose members are all in one component is done
    many = at.groupBy("k", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("k", "key")
    rest = materialize(at.join(many.hint("merge"), ["k", "key"]).join(lead.hint("merge"), ["k", "key"]))
    left = rest.filter("c <> hub_c").select("k", "key", F.col("fp").alias("a"), F.col("c").alias("ca"))
    right = rest.select("k", "key", F.col("fp").alias("b"), F.col("c").alias("cb"))
    found = left.join(right.hint("merge"), (left.k == right.k) & (left.key == right.key) & (left.ca != right.cb) & (distance(left.a, right.b) <= bits))
    more = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return star.union(more)


def components(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): smallest id that links of at most `bits` bits reach."""
    fps = materialize(fps)
    nodes = materialize(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    comp = connected_components(links(nodes, bits), "a", "b").withColumnRenamed("node", "fp")
    named = nodes.join(comp.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least.hint("merge"), "c").select("fp", "component_id")
    return fps.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    return components(fingerprints(docs, id_col, text_col, words), bits)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of docs that stand for their group: the one with the smallest id, with all its columns.

    Rows with the same id and different texts are different documents (ordered by id, then text hash); a row without
    an id stays only if its group has none with an id. Of rows repeated with id and text, one is kept.
    """
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    keyed = docs.withColumn("__sh_key", key)
    found = near_duplicates(keyed, "__sh_key", text_col, words, bits)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__sh_stay")).distinct()
    return keyed.join(stay, keyed["__sh_key"] == stay["__sh_stay"]).dropDuplicates(["__sh_key"]).drop("__sh_key", "__sh_stay")

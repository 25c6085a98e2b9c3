"""Near-duplicates by SuperMinHash: signatures from correlated ranks, bands, verified links, union-find groups.

Each element of a set has a permutation of the signature's places: at step j it offers j plus a fraction to its j-th place, and
a place keeps the smallest offer of all elements. As an element offers each of its ranks once, and to different places, the
places vary less together than those of independent hash functions. Steps come in order, so that a set is done as soon as
all of its places are filled at a step: a set of hundreds of elements needs two or three steps, not one for each place.
Here a step is taken for all sets of a batch at once that aren't done.

Nodes that share a band are candidates, at a similarity of 0.85 all but about one pair in 120,000; `neardup.links` looks
through each band's group by hubs and differences and confirms every link on the full sets. Groups are joined by hooking
and pointer jumping, which is union-find done to all nodes of a round at once.

Defined results: a text without words, or null, has no shingles, is linked with nothing and is its own component; repeated
rows are linked and each get their row back; a row without an id takes part in links but names a component only if no
other row of it has an id (then null, and not kept); an empty table gives an empty result. Only the id and text columns are
read, so that others can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.contraction import connected_components
from cutoffs.llm import neardup
from cutoffs.llm.common import mixed
from cutoffs.session import materialize

WORDS, SIMILARITY = 5, 0.85
ROWS, BANDS = 5, 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], places: int = ROWS * BANDS) -> np.ndarray:
    """The SuperMinHash signature of each set of 64-bit hashes, one row each; an empty set's is infinite throughout.

    A permutation is a Fisher-Yates shuffle of which only the steps taken so far are drawn: step j swaps place j with a place k
    from j on. What stands at k then is found by going back through the earlier swaps.
    """
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out = np.full((len(sets), places), np.inf)
    flat = out.reshape(-1)
    element = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for j in range(places):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            draw = mixed(element + _STEP * np.uint64(j + 1))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int16)
        at = k.copy()
        for t in range(j - 1, -1, -1):
            at = np.where(at == swaps[t], np.int16(t), at)
        np.minimum.at(flat, owner * places + at, j + (draw >> np.uint64(32)) / 4294967296.0)
        swaps.append(k)
        open_ = (out >= j + 1).any(axis=1)[owner]  # a later step can't lower what is filled by now
        if not open_.all():
            element, owner = element[open_], owner[open_]
            swaps = [s[open_] for s in swaps]
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of the bands of each set, one row each."""
    bits = signatures(sets).view(np.uint64).reshape(len(sets), BANDS, ROWS)
    key = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        key = mixed(key + bits[:, :, row] + np.uint64(1))
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    d = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    found = neardup.nodes(d, words, bands)
    full = found.filter("size > 0")
    comp = connected_components(neardup.links(d, full, words, similarity), "a", "b")
    of = full.groupBy("node").agg(F.min("key").alias("least")).join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    name = materialize(of.join(of.groupBy("c").agg(F.min("least").getField("id").alias("component_id")), "c").select("node", "component_id"))
    rows = found.select(F.col("key.id").alias("doc_id"), F.col("size").alias("n_shingles"), "node")
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).drop("node")
    out = rows.filter("n_shingles > 0").join(name, "node").drop("node").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

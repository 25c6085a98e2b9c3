"""Near-duplicates by word shingles: MinHash bands find candidates, the exact Jaccard similarity decides.

A document's shingles are the runs of `words` words of its ASCII-lower-cased text; a text of fewer words is one shingle.
Documents with the same set are one node. The smallest values of ROWS * BANDS hash functions over the set are cut into
bands; nodes that share a band are candidates, which at a similarity of 0.8 misses about one pair in 3,000. Of each
candidate pair the sets themselves are compared.

A band's group is not compared by all its pairs. In a few rounds all nodes of a group are compared with one hub, the one
with most neighbours; what that joins needs no more comparing, and the next round's hub is from the others. What is then
left is looked through by differences to a node in the middle of related groups. If x is not near that
node but near y, their differences to it must share over half of y's (see `_by_differences`), so x meets y only at
elements of the rarer part of y's difference. Copies that were changed in places of their own don't meet at all.

Bands miss few near pairs, but some. What they missed is found by prefixes: in any order of all shingles, two sets with a
Jaccard similarity of s share one of the first |x| - s|x| + 1 of x and of y. The order puts shingles that many texts of a bounded
sample have last, which changes what it costs and not what is found. Only nodes that bands didn't link yet meet there,
and sketches of both sets rule out nearly all that are not near.

Defined results: null and wordless texts have no shingles and are one node; repeated rows, null ids and one id with
different texts are as in `simhash.keep_one`; an empty table gives an empty result; all columns of docs stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.contraction import BROADCAST_ROWS, connected_components
from cutoffs.llm.common import SPACED, Words, drawn, lean, mixed, raw, steps
from cutoffs.session import materialize

#: Words of a shingle, and the Jaccard similarity from which two documents are near copies.
WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 20
#: Rounds with a hub for each group, at most.
HUBS = 3
#: Nodes that share an element of their prefixes and meet as pairs, at most; more go the way of a band's group.
PAIRS = 256
#: Texts that the shingles which many texts have are counted in, and how many of these are told to all tasks, at most.
SAMPLE, COMMON = 4_000, 65_536
#: Bits of a set's sketch.
SKETCH = 512
_ODD = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = Words(texts, SPACED)
    ends = np.cumsum(found.counts()).tolist()
    out = []
    for a, b in zip([0, *ends], ends, strict=False):
        h = found.hash[a:b]
        k = min(words, len(h))
        total = np.zeros(max(0, len(h) - k + 1) if k else 0, dtype=np.uint64)
        for j in range(k):
            total = mixed(total + h[j : j + len(total)] * np.uint64(2 * j + 1))
        out.append(np.unique(total))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of the bands of each set of shingle hashes, one row each."""
    return np.array([_bands(s) for s in sets], dtype=np.int64).reshape(len(sets), BANDS)


def _bands(s: np.ndarray) -> np.ndarray:
    # the upper bits of a product with an odd number, mixed once more, are as good as a hash function of its own
    least = np.array([(s * c ^ (s * c >> np.uint64(32))).min() if len(s) else 0 for c in _ODD], dtype=np.uint64)
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = mixed(key + row + np.uint64(1))
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits, each set if an odd number of the set's elements fall on it: two sets differ in as many elements at least
    as their sketches differ in bits."""
    bit = (mixed(s + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % SKETCH
    return np.packbits((np.bincount(bit, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch], words: int, keys_of: Callable[[list[np.ndarray]], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            sets = shingles(raw(part.column(1)), words)
            node = np.array([mixed(mixed(s).sum(dtype=np.uint64, keepdims=True))[0] for s in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array(list(keys_of(sets)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys], names=["key", "node", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            sets = shingles(raw(part.column(1)), words)
            grams = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), grams, pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64()))], names=["node", "grams", "odd"])


def nodes(d: DataFrame, words: int, keys_of: Callable[[list[np.ndarray]], np.ndarray] = bands) -> DataFrame:
    """(key, node, size, bands) for each row of d (key, text): its set's hash and size, and the keys of its bands."""
    kind = d.schema["key"].dataType.simpleString()
    return materialize(d.mapInArrow(lean(lambda it: _nodes(it, words, keys_of)), f"key {kind}, node bigint, size bigint, bands array<bigint>"))


def near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, grams) have at least the given Jaccard similarity."""
    sets = sets.select("node", "grams")
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.filter(common / (F.size("ga") + F.size("gb") - common) >= similarity).select("a", "b")


def _pairs(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """Enough links (a, b) between nodes to give all components of the candidates that are near copies.

    docs: (key, text). found: (key, node, size, bands) for each row of docs.
    """
    keyed = found.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands")).select("node", "size", F.posexplode("bands").alias("k", "band"))
    groups = keyed.groupBy("k", "band").agg(F.count("*").alias("n")).filter("n > 1")
    held = materialize(keyed.join(groups.hint("merge"), ["k", "band"]))
    member = materialize(held.drop("n").join(held.groupBy("node").agg(F.sum("n").alias("degree")), "node"))
    return _missed(docs, found, _linked(docs, found, member, None, words, similarity), words, similarity)


def _sets_of(docs: DataFrame, found: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """(node, grams, odd) of the nodes in some (node): one document of each stands for it."""
    key = materialize(found.groupBy("node").agg(F.min("key").alias("key")).join(some.select("node").distinct().hint("merge"), "node"))
    key = F.broadcast(key) if key.count() <= BROADCAST_ROWS else key.hint("merge")  # a few keys needn't move all texts
    return materialize(docs.join(key, "key").select("node", "text").dropDuplicates(["node"]).mapInArrow(lean(lambda it: _sets(it, words)), "node bigint, grams array<bigint>, odd array<bigint>"))


def _linked(docs: DataFrame, found: DataFrame, member: DataFrame, known: DataFrame | None, words: int, similarity: float) -> DataFrame:
    """known links (a, b), if any, and enough more to give all components of near nodes in groups (k, band, node, size, degree)."""
    sets = _sets_of(docs, found, member, words)
    fits = F.least("size", "hub_size") / F.greatest("size", "hub_size") >= similarity
    all_, hubs, first = known, None, None
    at = member.withColumn("c", F.col("node")) if known is None else materialize(_named(member, known))
    for _ in range(HUBS):
        open_ = at
        if hubs is not None:  # components that a former hub of the group is in give no further one
            past = hubs.join(at.select("k", "band", F.col("node").alias("hub"), "c"), ["k", "band", "hub"]).select("k", "band", "c")
            open_ = at.join(past.distinct(), ["k", "band", "c"], "left_anti")
        hub = materialize(open_.groupBy("k", "band").agg(F.max(F.struct("degree", "node", "size", "c")).alias("h")).select("k", "band", "h.degree", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.c").alias("hub_c")))
        pairs = at.join(hub.drop("degree"), ["k", "band"]).filter((F.col("c") != F.col("hub_c")) & fits).select(*_pairs("node", "hub")).distinct()
        new = materialize(near(pairs, sets, similarity))
        first = hub.select("k", "band", "degree", "hub") if first is None else first
        hubs = hub.select("k", "band", "hub") if hubs is None else hubs.union(hub.select("k", "band", "hub"))
        all_ = new if all_ is None else all_.union(new)
        if new.isEmpty():
            break
        named = materialize(_named(member, all_))
        several = named.groupBy("k", "band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("k", "band")
        at = materialize(named.join(several, ["k", "band"]))
        if at.isEmpty():
            return all_
    # related groups: of the first hubs of any group that a group's nodes are in, the one with the largest degree
    best = at.drop("degree").join(first, ["k", "band"]).groupBy("node").agg(F.max(F.struct("degree", "hub")).alias("best"))
    family = at.join(best, "node").groupBy("k", "band").agg(F.max("best").getField("hub").alias("family"))
    placed = materialize(at.join(family, ["k", "band"]).select("k", "band", "family", "node", "size", "c"))
    return all_.union(_by_differences(placed, _centres(placed.select("family", "node", "size", "c").distinct(), sets), sets, similarity))


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (node, ...) with the component c of each node."""
    comp = connected_components(known, "a", "b")
    comp = comp.hint("merge") if comp.count() > BROADCAST_ROWS else comp
    return rows.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """The shingles that one in a thousand texts of a sample have, and eight at least; the most frequent COMMON of them."""
    sample = materialize(drawn(docs, SAMPLE, "text").select(F.xxhash64("text").alias("node"), "text"))
    least = max(8, sample.count() // 1000)
    grams = sample.mapInArrow(lean(lambda it: _sets(it, words)), "node bigint, grams array<bigint>, odd array<bigint>").select(F.explode("grams").alias("e"))
    rows = grams.groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "e").limit(COMMON).select("e").collect()
    return np.sort(np.array([r["e"] for r in rows], dtype=np.int64).view(np.uint64))


def prefix(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a sorted set, of which any set with that Jaccard similarity has one among its own first."""
    most = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
    if not len(common):
        return s[:most]
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate((s[~last], s[last]))[:most]


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, common: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            sets = shingles(raw(part.column(0)), words)
            node = np.array([mixed(mixed(s).sum(dtype=np.uint64, keepdims=True))[0] for s in sets], dtype=np.uint64).view(np.int64)
            first = pa.array([prefix(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            odd = pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), odd, first], names=["node", "size", "odd", "first"])


def _missed(docs: DataFrame, found: DataFrame, known: DataFrame | None, words: int, similarity: float) -> DataFrame:
    """known links (a, b) and those that are still missing for the components of all near pairs."""
    known = found.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if known is None else materialize(known)
    common = _common(docs, words)
    first = docs.select("text").mapInArrow(lean(lambda it: _prefixes(it, words, common, similarity)), "node bigint, size bigint, odd array<bigint>, first array<bigint>")
    rows = materialize(_named(first, known))
    # one shuffle of short rows: elements that share 32 bits of a hash become one group, which costs pairs and no result
    one = Window.partitionBy("band")
    spread = rows.select(F.explode("first").alias("e"), "node", "c").select(F.hash("e").alias("band"), "node", "c")
    held = spread.withColumn("c0", F.min("c").over(one)).withColumn("c1", F.max("c").over(one)).filter("c0 < c1").drop("c0", "c1")
    held = materialize(held.dropDuplicates(["band", "node"]))
    if held.isEmpty():
        return known
    about = rows.select("node", "size", "odd").join(held.select("node").distinct().hint("merge"), "node").dropDuplicates(["node"])
    held = materialize(held.join(about.hint("merge"), "node"))
    n = materialize(held.groupBy("band").agg(F.count("*").alias("n")))
    few = held.join(n.filter(F.col("n") <= PAIRS).select("band").hint("merge"), "band")
    x = few.select("band", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("c").alias("cx"), F.col("odd").alias("ox"))
    y = few.select("band", F.col("node").alias("y"), F.col("size").alias("sy"), F.col("c").alias("cy"), F.col("odd").alias("oy"))
    t = (1 - similarity) / (1 + similarity)
    met = x.join(y.hint("merge"), "band").filter((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")))
    met = met.filter((F.least("sx", "sy") / F.greatest("sx", "sy") >= similarity) & (_bits() <= t * (F.col("sx") + F.col("sy")) + 1e-9))
    pairs = materialize(met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        known = materialize(known.union(near(pairs, _sets_of(docs, found, ends, words), similarity)))
    many = n.filter(F.col("n") > PAIRS)
    if many.isEmpty():
        return known
    group = materialize(held.join(many.hint("merge"), "band").select(F.lit(0).alias("k"), "band", "node", "size", "n"))
    degree = group.groupBy("node").agg(F.sum("n").alias("degree"))
    return _linked(docs, found, materialize(group.drop("n").join(degree.hint("merge"), "node")), known, words, similarity)


def _bits() -> Column:
    """In how many bits the sketches ox and oy differ."""
    return sum((F.bit_count(F.col("ox")[i].bitwiseXOR(F.col("oy")[i])) for i in range(SKETCH // 64)), F.lit(0))


def _centres(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, ref, ref_c): of each family in rest (family, node, size, c), the node nearest to what most of it has.

    Of a family of copies this is the text that they were made of, if it is there, or one with few changes.
    """
    grams = rest.join(sets, "node").select("family", "node", F.explode("grams").alias("e"))
    most = grams.groupBy("family", "e").agg(F.count("*").alias("n")).join(rest.groupBy("family").agg(F.count("*").alias("of")), "family")
    most = materialize(most.filter("2 * n > of").select("family", "e"))
    has = grams.join(most, ["family", "e"]).groupBy("family", "node").agg(F.count("*").alias("has"))
    # the size of the common part is the same for all nodes of a family
    centre = rest.join(has, ["family", "node"], "left").groupBy("family").agg(F.min(F.struct((F.col("size") - 2 * F.coalesce("has", F.lit(0))).alias("far"), "node", "c")).alias("m"))
    return materialize(centre.select("family", F.col("m.node").alias("ref"), F.col("m.c").alias("ref_c")))


def _by_differences(placed: DataFrame, centres: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of a family and different components, and from nodes to the family's ref.

    placed: k, band, family, node, size, component c. centres: family, ref, component ref_c. With t = (1 - similarity) /
    (1 + similarity), two sets are near if their symmetric difference has at most t times the sum of their sizes. Let X
    and Y be the symmetric differences of x and y with the ref h, and x not near h. Then x and y differ by |X| + |Y| - 2
    |X and Y|, so if they are near, |X and Y| >= (|X| + |Y| - t (|x| + |y|)) / 2, and since |X| > t (|x| + |h|), that is
    more than v = (|Y| + t (|h| - |y|)) / 2. So in any order of Y, one of its first |Y| - floor(v) elements is in X; the
    order taken has those first that fewest x have. Nodes near h are linked with it and so with each other.

    Where even these elements are common, as in texts that share a long passage and have little to do with h, y meets the
    x of its band groups instead, if they are fewer, and of these the ones that the distances to h and sketches of both
    sets don't rule out. Each y takes the way that has fewer rows, which is counted first.
    """
    t = (1 - similarity) / (1 + similarity)
    rest = placed.select("family", "node", "size", "c").distinct().join(centres, "family").filter("node <> ref")
    grams = sets.select("node", "grams")
    both = rest.join(grams.toDF("node", "gn"), "node").join(grams.toDF("ref", "gh"), "ref")
    less, more = F.array_except("gn", "gh"), F.array_except("gh", "gn")
    d = both.select("family", "node", "size", "c", "ref", "ref_c", F.size("gh").alias("ref_size"), F.array_union(less, more).alias("d"), (F.size("gn") - F.size(less)).alias("common"))
    d = d.withColumn("alike", F.col("common") / (F.col("size") + F.col("ref_size") - F.col("common")))
    d = materialize(d.withColumn("far", F.col("alike") < similarity))
    direct = d.filter("not far and c <> ref_c").select(*_pairs("node", "ref"))
    e = d.select("family", "node", "size", "c", "far", F.size("d").alias("n"), F.floor((F.size("d") + t * (F.col("ref_size") - F.col("size"))) / 2).alias("v"), F.explode("d").alias("e"))
    held = e.filter("far").groupBy("family", "e").agg(F.count("*").alias("f"))
    # far nodes that have the element, but for the node itself
    others = F.coalesce("f", F.lit(0)) - F.col("far").cast("int")
    order = Window.partitionBy("family", "node").orderBy("w", "e")
    y = e.join(held, ["family", "e"], "left").withColumn("w", others).withColumn("place", F.row_number().over(order))
    y = materialize(y.filter((F.col("place") <= F.col("n") - F.col("v")) & (F.col("w") > 0)).select("family", "e", F.col("node").alias("y"), F.col("size").alias("sy"), F.col("c").alias("cy"), "w"))
    by_e = y.groupBy("family", F.col("y").alias("node")).agg(F.sum("w").alias("by_e"))
    at = materialize(placed.join(d.select("family", "node", "far", "alike"), ["family", "node"]))
    far = at.groupBy("k", "band").agg(F.sum(F.col("far").cast("int")).alias("n_far"))
    by_band = at.join(far, ["k", "band"]).groupBy("family", "node").agg(F.sum(F.col("n_far") - F.col("far").cast("int")).alias("by_band"))
    banded = materialize(by_e.join(by_band, ["family", "node"]).filter("by_band < by_e").select("family", "node"))
    fits = lambda a, b: F.least(a, b) / F.greatest(a, b) >= similarity
    x = e.filter("far").select("family", "e", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("c").alias("cx"))
    met = x.join(y.join(banded.toDF("family", "y"), ["family", "y"], "left_anti"), ["family", "e"]).filter((F.col("cx") != F.col("cy")) & fits("sx", "sy"))
    # distances of sets obey the triangle: those to the ref differ by no more than the distance of the two
    close = (F.abs(F.col("ax") - F.col("ay")) <= 1 - similarity + 1e-9) & (_bits() <= t * (F.col("sx") + F.col("sy")) + 1e-9)
    at = at.join(sets.select("node", "odd"), "node")
    bx = at.filter("far").select("k", "band", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("c").alias("cx"), F.col("alike").alias("ax"), F.col("odd").alias("ox"))
    of_y = at.join(banded, ["family", "node"], "left_semi").select("k", "band", F.col("node").alias("y"), F.col("size").alias("sy"), F.col("c").alias("cy"), F.col("alike").alias("ay"), F.col("odd").alias("oy"))
    in_band = bx.join(of_y, ["k", "band"]).filter((F.col("cx") != F.col("cy")) & fits("sx", "sy") & close)
    found = met.select(*_pairs("x", "y")).union(in_band.select(*_pairs("x", "y"))).distinct()
    return direct.union(near(found, sets, similarity))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, keys_of: Callable[[list[np.ndarray]], np.ndarray] = bands) -> DataFrame:
    """The rows of docs that stand for their group: the one with the smallest id, with all its columns."""
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    keyed = docs.withColumn("__nd_key", key)
    d = keyed.select(F.col("__nd_key").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = nodes(d, words, keys_of)
    comp = connected_components(links(d, found, words, similarity), "a", "b")
    of = found.groupBy("node").agg(F.min("key").alias("key")).join(comp, "node", "left")
    stay = of.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("key").alias("__nd_stay")).select("__nd_stay")
    return keyed.join(stay, keyed["__nd_key"] == stay["__nd_stay"]).dropDuplicates(["__nd_key"]).drop("__nd_key", "__nd_stay")

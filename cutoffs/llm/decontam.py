"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Items and documents are lower-cased (A-Z only) and cut into words of letters, digits and characters beyond ASCII. The
automaton of all items is walked with the words of each document; after each word it knows the longest match that ends
there. Where that length reaches `window` (or a whole item of fewer words ends), the words of the window are hit. The
walk starts anew where a word or a pair of neighbours is in no item, since no match of two words can reach across; such
places are found for many documents at once, so that only stretches made of item pairs are walked.

The items are sent to the tasks in blocks of about BLOCK_WORDS words, one block after the other: each is a pass over
the documents whose result is written before the next block is built, so that driver and tasks hold one block's
automaton. The hits of all blocks are united.

Defined results: a null text (or item) has no words; items without words match nothing; a null item id counts hits but
is not listed; items repeated with their id count once; empty tables give results without hits; documents repeated are
treated one by one; other columns are carried along untouched by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.common import PLAIN, Words, lean, raw, steps
from cutoffs.session import materialize

WINDOW = 10
#: Share of hit words beyond which a document is dropped by `clean` rather than cut.
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000
_FLAG_BITS = 18


class Automaton:
    """Suffix automaton of several word sequences, with the windows that count as hits."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        found = Words([t for _, t in items], PLAIN)
        self.vocab = np.unique(found.hash)
        ids = np.searchsorted(self.vocab, found.hash).tolist()
        ends = np.cumsum(found.counts()).tolist()
        seqs = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.names = [n for n, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        paths = [self._add(s) for s in seqs]
        self._mark(seqs, paths)
        pairs = {a * len(self.vocab) + b for s in seqs for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.least = min((min(window, len(s)) for s in seqs if s), default=0)
        self.flags = np.zeros(1 << _FLAG_BITS, dtype=bool)
        self.flags[(self.vocab >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True

    def _copy(self, p: int, c: int, q: int) -> int:
        """Split the strings of q that are as long as p's plus c off into a state of their own."""
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _add(self, seq: list[int]) -> list[int]:
        """Insert a sequence from the root on; returns the state of each of its prefixes."""
        last, path = 0, []
        for c in seq:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._copy(last, c, q)
            else:
                new = len(self.len)
                self.next.append({})
                self.len.append(self.len[last] + 1)
                self.link.append(0)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._copy(p, c, q)
                last = new
            path.append(last)
        return path

    def _mark(self, seqs: list[list[int]], paths: list[list[int]]) -> None:
        n, w = len(self.len), self.window
        # states of prefixes can have been split after their insertion; walk the items again
        self.items: list[set[int]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, seq in enumerate(seqs):
            v = 0
            for c in seq:
                v = self.next[v][c]
                p = v
                while p > 0 and self.len[p] >= w and k not in self.items[p]:
                    self.items[p].add(k)
                    p = self.link[p]
            if 0 < len(seq) < w:
                self.short[v].append((len(seq), k))
        order = sorted(range(n), key=self.len.__getitem__)
        self.at_window, self.short_up = [-1] * n, [-1] * n
        for v in order[1:]:
            up = self.link[v]
            if self.len[v] >= w:
                self.at_window[v] = v if self.len[up] < w else self.at_window[up]
            self.short_up[v] = up if self.short[up] else self.short_up[up]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 if it is in no item."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.vocab):
            maybe = np.flatnonzero(self.flags[(hashes >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocab, hashes[maybe]), len(self.vocab) - 1)
            out[maybe] = np.where(self.vocab[at] == hashes[maybe], at, -1)
        return out

    def stretches(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal runs of known words whose neighbours are neighbours in some item, if long enough for a hit."""
        if not self.least:
            return
        known = ids >= 0
        joined = np.zeros(len(ids), dtype=bool)  # with the word before
        near = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1])) + 1
        if len(self.pairs):
            key = ids[near - 1] * len(self.vocab) + ids[near]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[near] = self.pairs[at] == key
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = ends - starts >= self.least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def walk(self, ids: list[int], base: int) -> Iterator[tuple[int, int, set[int]]]:
        """(first, last + 1, items) of each window that ends in the stretch; positions count from base."""
        v = length = 0
        for i, c in enumerate(ids, base + 1):
            while v and c not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            v = self.next[v].get(c, 0)
            length = length + 1 if v else 0
            if length >= self.window:
                yield i - self.window, i, self.items[self.at_window[v]]
            p = v
            while p > 0:
                for m, k in self.short[p]:
                    if m <= length:
                        yield i - m, i, {k}
                p = self.short_up[p]

    def hits(self, texts: list[bytes]) -> tuple[Words, np.ndarray, list[set[int]]]:
        """Words of the texts, a flag for each hit word, and the items found in each text."""
        words = Words(texts, PLAIN)
        ids = self.lookup(words.hash)
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        items: list[set[int]] = [set() for _ in texts]
        for a, b in self.stretches(ids, words.doc):
            for x, y, ks in self.walk(ids[a:b].tolist(), a):
                edge[x] += 1
                edge[y] -= 1
                items[int(words.doc[a])] |= ks
        return words, np.cumsum(edge[:-1]) > 0, items


def block_count(items: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> int:
    """How many blocks of about block_words words the items make, at five characters a word."""
    chars = items.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-chars // (5 * block_words)))


def automata(items: DataFrame, blocks: int, window: int = WINDOW, item_id: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """The automaton of each block of items, which a hash of id and text chooses."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).dropDuplicates(["id", "text"])
        yield Automaton([(r["id"], r["text"].encode()) for r in block.toLocalIterator()], window)


def _scan(batches: Iterator[pa.RecordBatch], shared, before: bool) -> Iterator[pa.RecordBatch]:
    auto = shared.value
    for batch in batches:
        for part in steps(batch):
            texts = raw(part.column(1))
            words, hit, items = auto.hits(texts)
            ends = np.cumsum(words.counts())
            names = [{auto.names[k] for k in ks if auto.names[k] is not None} for ks in items]
            spots = [np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(np.append(0, ends), ends, strict=False)]
            if before:
                spots = [np.union1d(x, np.asarray(y, dtype=np.int32)) for x, y in zip(spots, part.column(3).to_pylist(), strict=True)]
                names = [x | set(y) for x, y in zip(names, part.column(4).to_pylist(), strict=True)]
            columns = [part.column(0), part.column(1), pa.array(words.counts(), pa.int64()), pa.array(spots, pa.list_(pa.int32())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "hit", "items"])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, n_words, hit, items) for each row: positions of hit words and sorted ids of the items found."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    blocks = block_count(items, item_text, block_words)
    for k, auto in enumerate(automata(items, blocks, window, item_id, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(auto)
        out = out.mapInArrow(lean(lambda it, s=shared, b=k > 0: _scan(it, s, b)), f"doc_id {kind}, text string, n_words bigint, hit array<int>, items array<string>")
        if blocks > 1:
            out = materialize(out)
            shared.destroy()
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    found = find(docs, items, window, **columns)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def without(text: bytes, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its hit spans; start and end of each word are places in the text."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    keep, at = [], 0
    for a, b in zip(edge[::2], edge[1::2] - 1, strict=True):
        keep.append(text[at : start[a]])
        at = int(end[b])
    return b"".join([*keep, text[at:]])


def _mark(batches: Iterator[pa.RecordBatch], shared, text: str) -> Iterator[pa.RecordBatch]:
    """Adds the hits of one block to the last column."""
    auto = shared.value
    for batch in batches:
        for part in steps(batch, text):
            words, hit, _ = auto.hits(raw(part.column(part.schema.get_field_index(text))))
            ends = np.cumsum(words.counts())
            spots = [np.flatnonzero(hit[a:b]) for a, b in zip(np.append(0, ends), ends, strict=False)]
            spots = [np.union1d(x, y).astype(np.int32) for x, y in zip(spots, part.columns[-1].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spots, pa.list_(pa.int32()))], schema=part.schema)


def _cut(batches: Iterator[pa.RecordBatch], text: str, max_coverage: float) -> Iterator[pa.RecordBatch]:
    """Cuts the hit words of the last column out of the text, or drops the row."""
    for batch in batches:
        k = batch.schema.get_field_index(text)
        for part in steps(batch, text):
            texts, spots = raw(part.column(k)), part.columns[-1].to_pylist()
            new: list[str | None] = part.column(k).to_pylist()
            stay = np.ones(len(texts), dtype=bool)
            for i, at in enumerate(spots):
                if at:
                    words = Words([texts[i]], PLAIN, hashes=False)
                    hit = np.zeros(len(words.start), dtype=bool)
                    hit[at] = True
                    stay[i] = hit.mean() <= max_coverage
                    new[i] = without(texts[i], words.start, words.end, hit).decode()
            cols = [pa.array(new, part.schema.field(k).type) if j == k else c for j, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema).filter(pa.array(stay))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit spans cut out of the text, and without the documents of which more than max_coverage is hit.

    A span runs from its first to its last hit word; what stands between spans, and its case and punctuation, stays. The
    hits of all blocks are united before anything is cut; documents that were cut are looked through again until no
    block hits them.
    """
    sc, blocks = docs.sparkSession.sparkContext, block_count(items, block_words=block_words)
    only = [sc.broadcast(auto) for auto in automata(items, 1, window)] if blocks == 1 else []
    todo, done = docs.withColumn("__dc_hit", F.array().cast("array<int>")), []
    while True:
        for k, shared in enumerate(only or map(sc.broadcast, automata(items, blocks, window))):
            # the last block's pass cuts as well
            cut = k == blocks - 1
            todo = materialize(todo.mapInArrow(lean(lambda it, s=shared, c=cut: _cut(_mark(it, s, text_col), text_col, max_coverage) if c else _mark(it, s, text_col)), todo.schema))
            if not only:
                shared.destroy()
        done.append(todo.filter(F.size("__dc_hit") == 0).drop("__dc_hit"))
        todo = todo.filter(F.size("__dc_hit") > 0)
        if todo.isEmpty():
            return reduce(DataFrame.union, done)
        todo = todo.withColumn("__dc_hit", F.array().cast("array<int>"))


def items_digest(names: list[str]) -> str:
    """The digest of a set of item ids, as `report` gives it."""
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()

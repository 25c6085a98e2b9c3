"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the rank of each adjacent pair of symbols, an inner node the smaller of its children, so
the root yields the lowest rank and the leftmost place that has it. A merge changes three leaves at most (the merged
pair dies, its neighbours get new ranks), each updated along one path of the tree, until the root holds no mergeable
pair. Trees of many words are worked on together, a column per word, so that each step is a handful of array operations.

The tokenizer file gives vocabulary, merges and the pattern of words. Its normaliser has to be NFC, white space to a
space, lower case, its words byte-level ones without a decoder; another file is refused. Distinct chunks of text between
white space are encoded once and kept in a cache of bounded size, which changes nothing in the results. Decoding looks
the tokens of the ids up and joins them by a space.

Defined results: a null text is empty and has no tokens; repeated rows are encoded one by one; an empty table gives an
empty result; only the id and text (or ids) columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.common import Kept, lean, steps

#: Chunks of a generation that a task keeps encoded; there are two at most.
CACHE_WORDS = 100_000
NEVER = np.int32(2**31 - 1)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """Ranks and results of symbol pairs, found in small hash tables over packed pairs."""

    SLOTS = 20

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            first[vocab[a], vocab[b]] = (rank, vocab[a + b])  # of pairs listed twice, the last counts
        self.size = len(vocab) + 1
        self.key = np.array([a * self.size + b for a, b in first] + [-1], dtype=np.int64)
        self.rank = np.array([r for r, _ in first.values()] + [NEVER], dtype=np.int32)
        self.to = np.array([t for _, t in first.values()] + [-1], dtype=np.int32)
        # keys that share a slot go on to the next table, under another multiplier
        self.tables, rest, factor = [], np.arange(len(first)), 0x9E3779B97F4A7C15
        while len(rest):
            slot = self._slot(self.key[rest], factor)
            table = np.full(1 << self.SLOTS, len(first), dtype=np.int32)
            table[slot] = rest
            self.tables.append((np.uint64(factor), table))
            rest, factor = rest[table[slot] != rest], (factor * 0xD1342543DE82EF95) % (1 << 64) | 1

    def _slot(self, key: np.ndarray, factor: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair (the last index if it is not mergeable); negative symbols are in no pair."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        out = np.full(len(key), len(self.key) - 1, dtype=np.int32)
        for factor, table in self.tables:
            at = table[self._slot(key, factor)]
            hit = self.key[at] == key
            out[hit] = at[hit]
        return out


class PairTree:
    """Segment trees over the adjacent pair ranks of n words of up to `width` symbols, all stepped together.

    The tree of a word is a stretch of 2 * size entries: entry 1 is the root, entry size + i the pair (i, next of i).
    """

    def __init__(self, symbols: np.ndarray, merges: Merges):
        self.merges, (n, width) = merges, symbols.shape
        self.width, self.size = width, width
        self.sym = symbols.ravel()
        lengths = (symbols >= 0).sum(axis=1)
        self.left = np.tile(np.arange(-1, width - 1, dtype=np.int64), n)
        right = np.tile(np.arange(1, width + 1, dtype=np.int64), (n, 1))
        right[np.arange(n), np.maximum(lengths - 1, 0)] = width
        self.right = right.ravel()
        tree = np.full((n, 2 * width), NEVER, dtype=np.int32)
        tree[:, width : 2 * width - 1] = merges.rank[merges.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())].reshape(n, width - 1)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        self.tree, self.n = tree.ravel(), n

    def _set(self, word: np.ndarray, leaf: np.ndarray, rank: np.ndarray | np.int32) -> None:
        """Point update of one leaf in each of the given words, with its path to the root."""
        tree, base = self.tree, word * (2 * self.size)
        at = leaf + self.size
        tree[base + at] = rank
        for _ in range(self.size.bit_length() - 1):
            at = at >> 1
            below = base + 2 * at
            tree[base + at] = np.minimum(tree[below], tree[below + 1])

    def _rank(self, i: np.ndarray, j: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ranks of the pairs at flat places i and j; ends marks those without a second symbol."""
        b = self.sym[np.where(ends, i, j)].copy()
        b[ends] = -1
        return self.merges.rank[self.merges.find(self.sym[i], b)]

    def run(self) -> np.ndarray:
        """The symbols left after all merges, -1 where a symbol was merged away."""
        size, width, tree, sym = self.size, self.width, self.tree, self.sym
        word = np.flatnonzero(tree[1 :: 2 * size] < NEVER)
        while len(word):
            base = word * (2 * size)
            root, at = tree[base + 1], np.ones(len(word), dtype=np.int64)
            for _ in range(size.bit_length() - 1):  # down to the leftmost leaf with the root's rank
                at = 2 * at
                at += tree[base + at] != root
            i, flat = at - size, word * width
            j = self.right[flat + i]
            k = self.right[flat + j]
            sym[flat + i] = self.merges.to[self.merges.find(sym[flat + i], sym[flat + j])]
            sym[flat + j] = -1
            self.right[flat + i] = k
            ends = k >= width
            inner = ~ends
            self.left[(flat + k)[inner]] = i[inner]
            self._set(word, j, NEVER)
            self._set(word, i, self._rank(flat + i, flat + k, ends))
            h = self.left[flat + i]
            some = np.flatnonzero(h >= 0)
            if len(some):
                w, f, h = word[some], flat[some], h[some]
                self._set(w, h, self._rank(f + h, f + i[some], np.zeros(len(some), dtype=bool)))
            word = word[tree[base + 1] < NEVER]
        return sym.reshape(self.n, width)


class WordBpe:
    """A word-level BPE with word ends, as read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps_of = [(n["type"], n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        kinds = [p["type"] for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        if model["type"] != "BPE" or steps_of != [("NFC", None), ("Replace", " "), ("Lowercase", None)] or kinds != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing word-level BPE without a decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges = Merges(self.vocab, model["merges"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.heads = {c[:2] for c in added}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.symbol = byte_symbols()
        self.token = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.kept = Kept(CACHE_WORDS)

    def split_hint(self, text: str) -> bool:
        return any(h in text for h in self.heads)

    def normalise(self, text: str) -> str:
        """NFC and lower case of text without white space, character by character (no final sigma)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, which no word reaches across; strings of added tokens stand alone."""
        if not self.split_hint(text) or not self.split_added.search(text):
            return self._cut(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*self._cut(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self._cut(text[at:])

    @staticmethod
    def _cut(text: str) -> list[str]:
        """str.split, but that the four separator controls are no white space to the tokenizer."""
        return regex.split(r"\s+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks of text and keep their ids as bytes."""
        cut = {c: [c] if c in self.added else self.words.findall(self.normalise(c)) for c in chunks}
        done: dict[str, bytes] = {c: np.uint32(i).tobytes() for c, i in self.added.items()}
        by_width: dict[int, list[tuple[str, list[int]]]] = {}
        vocab, symbol, end = self.vocab, self.symbol, self.end
        for w in {w for ws in cut.values() for w in ws} - self.added.keys():
            marks = [symbol[b] for b in w.encode()]
            marks[-1] += end
            # symbols outside the vocabulary vanish, as in a model without an unknown token
            ids = [vocab[c] for c in marks if c in vocab]
            by_width.setdefault(1 << max(1, (len(ids) - 1).bit_length()), []).append((w, ids))
        for width, group in by_width.items():
            for a in range(0, len(group), step := max(1, 200_000 // width)):
                part = group[a : a + step]
                sym = np.array([ids + [-1] * (width - len(ids)) for _, ids in part], dtype=np.int32)
                out = PairTree(sym, self.merges).run()
                some = out >= 0
                data, start = out[some].astype("<u4").tobytes(), 0
                for (w, _), stop in zip(part, np.cumsum(4 * some.sum(axis=1)).tolist(), strict=True):
                    done[w] = data[start:stop]
                    start = stop
        for c, ws in cut.items():
            self.kept.young[c] = done[ws[0]] if len(ws) == 1 else b"".join([done[w] for w in ws])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        new = self.kept.missing({w for ws in cut for w in ws})
        if new:
            self.learn(sorted(new))
        kept = self.kept.young
        return [b"".join([kept[w] for w in ws]) for ws in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text, in UTF-8, of ids as little-endian 32-bit integers; an unknown id stands for nothing."""
        return b" ".join([t for t in map(self.token.get, np.frombuffer(ids, dtype="<u4").tolist()) if t is not None])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a file without a decoder asks for."""
        return self.decode_bytes(np.array(ids, dtype="<u4").tobytes()).decode()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """Document ids, token ids and decoded texts of some rows at a time."""
    bpe = word_bpe(path)
    for batch in batches:
        for part in steps(batch):
            ids = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
            yield part.column(0), ids, list(map(bpe.decode_bytes, ids))


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for doc, ids, text in _encode(batches, path):
        yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(lambda it: _texts(it, path)), f"doc_id {kind}, ids binary, decoded string")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for batch in batches:
        text = [None if x is None else bpe.decode_bytes(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows of ids, little-endian unsigned 32-bit integers as `encode` gives them; null for null."""
    d = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(lambda it: _decode(it, path)), f"doc_id {kind}, decoded string")


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for doc, ids, text in _encode(batches, path):
        columns = [doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(sha, ids)), pa.string()), pa.array(list(map(sha, text)), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode`, without moving ids and texts out of the tasks."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(lambda it: _digests(it, path)), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

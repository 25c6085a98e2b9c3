"""Toxicity with a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words is the sum, over all sequences of ORDER characters that are in both in order, of GAP to the power
of the characters they span in either word (SPAN at most), so that letters put between those of an insult only lower it.
Each word is expanded into these subsequences once per task; what a landmark lacks adds nothing. Landmarks are
words that mark toxic documents (not too alike), and a few frequent ones. A sentence's kernel with a landmark is the
largest normalised kernel of its words (kernels under FLOOR count as zero); the landmark kernel matrix turns these into
features (Nystroem). The machine is trained on sentences: of a toxic document the one that scores highest, of others
the hardest that have a feature, and on landmarks with characters put in. A document's score is a logistic function of its
highest sentence.

Of the sentences of others that have a feature, the fit takes the HARD with the highest values in each round, and the
highest of each document; that is a bound on what the machine is fitted to, as SAMPLE_ROWS is.

Words are what stands between white space, lower-cased, without characters other than letters and digits; a run of
three or more single characters is one more word. The fit uses at most SAMPLE_ROWS labelled documents of each class,
drawn by a hash of their id.

Defined results: a null or wordless text gets the score of a sentence without features; repeated rows are scored one by
one; labelled rows without a label value are not learnt from; with one class only the score is that class's share; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.common import PLAIN, SPACED, STEP_BYTES, Words, drawn, lean, raw, steps

ORDER, SPAN, GAP, FLOOR = 3, 7, 0.6, 0.3
LANDMARKS, PLAIN_LANDMARKS = 42, 6
#: Landmarks are less alike than this.
ALIKE = 0.6
SAMPLE_ROWS = 2000
#: Sentences of other documents that a round fits to, beside the highest of each document.
HARD = 4000
#: Landmarks are at most this long.
SHORT = 20
#: Words whose kernels a task keeps; when it is full, they are computed anew.
MEMO_WORDS = 600_000
#: Classes of characters: a to z, digits as one, and the rest by hash.
_ALPHABET = 64
_OTHER = regex.compile(r"[\W_]+")
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", dtype=np.uint8))


def plain(chunk: bytes) -> str:
    """A chunk of text as a word: lower case, letters and digits only."""
    return _OTHER.sub("", chunk.decode().lower())


@dataclass
class Units:
    """The words of several texts: hashes of distinct ones, how to get one, number and sentence of each token."""

    hashes: list[int]
    word: Callable[[int], str]
    number: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray


def units(texts: list[bytes]) -> Units:
    """Cuts texts into words and sentences; doc has the text of each sentence."""
    words = Words(texts, SPACED)
    none = np.zeros(0, dtype=np.int64)
    if not len(words.start):
        return Units([], lambda i: "", none, none, none)
    found, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    last = _ENDS[words.buf[words.end - 1]] | (words.buf[words.end] == 10)
    new = np.append(True, last[:-1] | (words.doc[1:] != words.doc[:-1]))
    sentence = np.cumsum(new) - 1
    single = words.end - words.start == 1
    single[single] &= PLAIN[words.buf[words.start[single]]] == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    spelled, hashes = [], found.tolist()
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 3:
            spelled.append(b"".join(words.word(i) for i in range(a, b)))
            hashes.append(hash(spelled[-1]))
            number = np.append(number, len(hashes) - 1)
            sentence = np.append(sentence, sentence[a])
    n = len(first)
    return Units(hashes, lambda i: plain(words.word(first[i]) if i < n else spelled[i - n]), number, sentence, words.doc[np.flatnonzero(new)])


def _codes(words: list[str], width: int) -> np.ndarray:
    """Character classes of words of one length, as a matrix."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    letter = flat - ord("a")
    out = np.where((letter >= 0) & (letter < 26), letter, np.where((flat >= 48) & (flat < 58), 26, 27 + (flat * 2654435761 >> 8) % (_ALPHABET - 27)))
    return out.reshape(len(words), width)


@lru_cache(maxsize=256)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER out of n characters that span at most SPAN, and their weights."""
    inner = np.array(list(combinations(range(1, SPAN), ORDER - 1)), dtype=np.int64)
    at = np.concatenate((np.zeros((len(inner), 1), dtype=np.int64), inner), axis=1)[None] + np.arange(n)[:, None, None]
    at = at.reshape(-1, ORDER)
    at = at[at[:, -1] < n]
    return at, GAP ** (at[:, -1] - at[:, 0] + 1.0)


def _expanded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all subsequences of each word, a row per word (the weights are the same for all)."""
    at, weight = _places(codes.shape[1])
    key = np.zeros((len(codes), len(at)), dtype=np.int64)
    for k in range(ORDER):
        key = key * _ALPHABET + codes[:, at[:, k]]
    return key, weight


def _self(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself."""
    order = np.argsort(key, axis=1)
    k, w = np.take_along_axis(key, order, axis=1), weight[order]
    new = np.ones(k.shape, dtype=bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    owner = np.nonzero(new)[0]
    return np.bincount(owner, weights=sums**2, minlength=len(key))


class Kernel:
    """Normalised kernels of words with a fixed set of landmark words."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        rows: dict[int, np.ndarray] = {}
        norms = []
        for m, w in enumerate(landmarks):
            key, weight = _expanded(_codes([w], len(w)))
            norms.append(np.sqrt(_self(key, weight)[0]))
            for c, x in zip(key[0].tolist(), weight.tolist(), strict=True):
                rows.setdefault(c, np.zeros(len(landmarks)))[m] += x
        self.row_of = np.zeros(_ALPHABET**ORDER, dtype=np.int32)
        self.table = np.zeros((len(rows) + 1, len(landmarks)), dtype=np.float32)
        for k, (c, x) in enumerate(rows.items(), 1):
            self.row_of[c] = k
            self.table[k] = x / np.array(norms)
        self.reset()

    def reset(self) -> None:
        self.memo: dict[int, int] = {}
        self.store = [np.zeros((1, len(self.landmarks)), dtype=np.float32)]
        self.stored = 1

    def of_hashed(self, hashes: list[int], word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel rows, row of each hash); word(i) gives the i-th word and is called for unknown ones only."""
        if len(self.memo) > MEMO_WORDS:
            self.reset()
        memo = self.memo
        new = [i for i, h in enumerate(hashes) if h not in memo]
        got = self.of([word(i) for i in new])
        live = got.any(axis=1)
        rows = np.zeros(len(new), dtype=np.int64)
        rows[live] = self.stored + np.arange(live.sum())
        memo.update(zip([hashes[i] for i in new], rows.tolist(), strict=True))
        self.store = [np.concatenate([*self.store, got[live]])]
        self.stored += int(live.sum())
        return self.store[0], np.array([memo[h] for h in hashes], dtype=np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """(words x landmarks) kernels, 0 for words of fewer than ORDER characters and for kernels under FLOOR."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, rows in by_len.items():
            if n < ORDER:
                continue
            size = max(1, 300_000 // len(_places(n)[0]))
            for a in range(0, len(rows), size):
                part = rows[a : a + size]
                key, weight = _expanded(_codes([words[i] for i in part], n))
                row = self.row_of[key]
                w_at, s_at = np.nonzero(row)
                if not len(w_at):
                    continue
                begin = np.flatnonzero(np.append(True, w_at[1:] != w_at[:-1]))
                hit = w_at[begin]
                sums = np.add.reduceat(self.table[row[w_at, s_at]] * weight[s_at][:, None].astype(np.float32), begin, axis=0)
                out[np.array(part)[hit]] = sums / np.sqrt(_self(key[hit], weight))[:, None]
        out[out < FLOOR] = 0
        return out


@dataclass
class Model:
    kernel: Kernel | None
    lift: np.ndarray | None = None
    weight: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(features, text number) of each sentence that has a word like a landmark."""
        u = units(texts)
        kernels, row = self.kernel.of_hashed(u.hashes, u.word)
        row = row[u.number]
        at = np.flatnonzero(row)
        at = at[np.argsort(u.sentence[at], kind="stable")]
        if not len(at):
            return np.zeros((0, len(self.kernel.landmarks)), dtype=np.float32), at
        begin = np.flatnonzero(np.append(True, np.diff(u.sentence[at]) != 0))
        return np.maximum.reduceat(kernels[row[at]], begin, axis=0) @ self.lift, u.doc[u.sentence[at[begin]]]

    def best(self, texts: list[bytes]) -> np.ndarray:
        """The highest decision value of each text's sentences."""
        feats, doc = self.features(texts)
        out = np.full(len(texts), self.bias)
        np.maximum.at(out, doc, feats @ self.weight + self.bias)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.best(texts) + self.offset, -50, 50)))


def slices(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of stretches of about limit bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def choose_landmarks(texts: list[bytes], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Words that tell toxic documents from others, best first and not too alike; frequent words of others."""
    bad, good = Counter(), Counter()
    for start, part in slices(texts):
        u, names = units(part), {}
        same = np.array([names.setdefault(u.word(i), len(names)) for i in range(len(u.hashes))], dtype=np.int64)
        distinct = list(names)
        pairs = np.unique(np.stack([same[u.number], u.doc[u.sentence]], axis=1), axis=0) if distinct else np.zeros((0, 2), dtype=np.int64)
        for c, y in ((bad, True), (good, False)):
            for k, n in zip(*np.unique(pairs[toxic[start + pairs[:, 1]] == y, 0], return_counts=True), strict=True):
                if ORDER <= len(distinct[k]) <= SHORT:
                    c[distinct[k]] += int(n)
    n_bad, n_good = max(1, toxic.sum()), max(1, (~toxic).sum())
    odds = {w: np.log((c + 0.5) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1)) for w, c in bad.items() if c >= 3}
    ranked = sorted((w for w in odds if odds[w] > 1), key=lambda w: (-bad[w] * odds[w], w))
    chosen: list[str] = []
    for w in ranked[: 10 * LANDMARKS]:
        if len(chosen) < LANDMARKS and (not chosen or Kernel([w]).of(chosen).max() < ALIKE):
            chosen.append(w)
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if w not in chosen]
    return chosen, common[:PLAIN_LANDMARKS]


def altered(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in at each place, with a letter doubled, and as it is."""
    i, c = int(rng.integers(1, len(word))), "abcdefghijklmnopqrstuvwxyz"
    put = [word[:j] + c[int(rng.integers(26))] + word[j:] for j in range(1, len(word))]
    return [*put, word[:i] + word[i - 1] + word[i:], word]


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent on the squared hinge loss; classes weigh the same."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y, 1.0, -1.0)
    bound = cost * np.where(y, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (~y).sum())))
    diag = (x1**2).sum(axis=1) + 0.5 / bound
    a, w = np.zeros(len(x)), np.zeros(x1.shape[1])
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = max(0.0, a[i] - (sign[i] * (x1[i] @ w) - 1 + 0.5 / bound[i] * a[i]) / diag[i])
            if new != a[i]:
                w += (new - a[i]) * sign[i] * x1[i]
                a[i] = new
    return w[:-1], float(w[-1])


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    if toxic.all() or not toxic.any():
        return Model(None, offset=float(toxic.mean()) if len(toxic) else 0.0)
    marks, common = choose_landmarks(texts, toxic)
    if not marks:
        return Model(None, offset=float(toxic.mean()))
    model = Model(Kernel(marks + common))
    gram = model.kernel.of(marks + common).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    model.lift = (vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T).astype(np.float32)
    found = [(start, *model.features(part)) for start, part in slices(texts)]
    feats = np.concatenate([f for _, f, _ in found]).astype(np.float64)
    doc = np.concatenate([start + d for start, _, d in found]).astype(np.int64)
    # round 0: a toxic document's witness is the sentence with the largest kernel with any toxic landmark
    value = (feats @ np.linalg.inv(model.lift.astype(np.float64)))[:, : len(marks)].max(axis=1)
    rng = np.random.default_rng(5)
    spelled = model.features([w.encode() for m in marks for w in altered(m, rng)])[0].astype(np.float64)
    hard = toxic[doc]
    for _ in range(3):
        order = np.lexsort((-value, doc))
        best = order[np.append(True, doc[order][1:] != doc[order][:-1])]
        others = np.flatnonzero(~hard)
        others = np.union1d(others[np.argsort(-value[others], kind="stable")[:HARD]], best[~hard[best]])
        rows = np.concatenate((best[hard[best]], others))
        x = np.vstack((feats[rows], spelled, np.zeros((1, feats.shape[1]))))
        y = np.concatenate((hard[rows], np.ones(len(spelled), dtype=bool), [False]))
        model.weight, model.bias = linear_svm(x, y)
        value = feats @ model.weight + model.bias
    top = np.full(len(texts), model.bias)
    np.maximum.at(top, doc, value)
    slope, offset = 1.0, 0.0
    for _ in range(200):  # logistic fit of the documents' best sentences
        p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -50, 50)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * top * top).sum() + 1, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((p - toxic) * top).sum() + (slope - 1), (p - toxic).sum()])
        slope, offset = max(0.1, slope - np.clip(step[0], -1, 1)), offset - np.clip(step[1], -1, 1)
    model.slope, model.offset = float(slope), float(offset)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit to at most `rows` labelled ids of either class, those with the smallest hash; only their texts are fetched."""
    y = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    chosen = [drawn(y.filter(F.col("y") == k), rows, "id") for k in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * rows ids at most
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(ids, "id")
    got = d.groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    toxic = got["y"].to_numpy() == 1
    model = fit([t.encode() for t in got["text"]], toxic)
    size = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if model.kernel is not None:  # from the classes' shares in the sample to those in all labelled rows
        model.offset += float(np.log(size[1] / size[0]) - np.log(toxic.sum() / (~toxic).sum()))
    return model


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(raw(part.column(1))))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    if model.kernel is not None:
        model.kernel.reset()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the number of landmarks bounds its size
    return d.mapInArrow(lean(lambda it: _score(it, shared)), f"doc_id {kind}, score double")

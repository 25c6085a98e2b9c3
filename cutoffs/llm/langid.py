"""Language identification with a linear-chain conditional random field over the words of a text.

Each word has as features its character n-grams with word boundaries (those at a boundary are its affixes) and itself
(the lexicon), hashed into a fixed number of weights per language; moves between languages have learned weights, so
that a code-switched text can change its language between any two words. Forward-backward gives the probability of
every language at every word; a document's language is the one with the largest mean over its words (of equal ones the
first by name). A text is one chain, however long: its stretches of CHAIN_WORDS words are stepped side by side, with the
weights that come over their borders from either side worked out first, so that steps don't grow with the longest text.

The field is fitted on the driver to whole texts of at most SAMPLE_ROWS labelled rows, drawn by a hash of their id and
text. A document has one label for all its words, so that a switch is never seen in it; of each batch some texts are
therefore joined in pairs to one chain, with the words' labels changing where they meet.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without a label are not learnt from;
with nothing to learn from every text is `und`; repeated rows are scored one by one; an empty table gives an empty
result; `predict` reads the id and text columns only, `keep_known` carries all columns along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.chain import Chains
from cutoffs.llm.common import Words, drawn, lean, members, mixed, steps

#: Labelled rows that the field is fitted to, at most.
SAMPLE_ROWS = 2000
FEATURE_BITS = 17
EPOCHS, RATE, DECAY = 3, 0.3, 1e-4
#: Words of a stretch, at most (stretches are stepped together, as many steps as the longest has words); of PAIR_OF texts of
#: a batch, two are joined.
CHAIN_WORDS, PAIR_OF = 4096, 8
#: Words that are stepped through at once.
STEP_WORDS = 400_000
#: Mean probability under which `keep_known` rejects a document.
KEEP_SCORE = 0.3
LETTERS = members((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words in turn, where each word's features begin)."""
    buf = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    end = np.cumsum(size)
    start = end - size
    code, out, where = np.zeros(len(buf), dtype=np.uint64), [], []
    owner = np.repeat(np.arange(len(words)), size)
    for n in range(1, 5):
        # the last n bytes up to each place, if they are in one word
        code = (np.concatenate((np.zeros(1, dtype=np.uint64), code[:-1])) << np.uint64(8)) | buf if n > 1 else buf.copy()
        own = code & np.uint64((1 << (8 * n)) - 1)
        inside = np.arange(len(buf)) - start[owner] >= n - 1
        out.append((mixed(own * np.uint64(8) + np.uint64(n))[inside] & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int32))
        where.append(owner[inside])
        code = own
    whole = np.add.reduceat(mixed(buf + (np.arange(len(buf)) - start[owner]).astype(np.uint64) * np.uint64(257)), start)
    out.append((mixed(whole) & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int32))
    where.append(np.arange(len(words)))
    feats, owners = np.concatenate(out), np.concatenate(where)
    order = np.argsort(owners, kind="stable")
    return feats[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Field:
    """Languages, weights of features by language, weights of moves and of the first word."""

    langs: list[str]
    weight: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of distinct words by language, with their features."""
        feats, begin = word_features(words)
        counts = np.diff(np.append(begin, len(feats)))
        return np.add.reduceat(self.weight[feats], begin, axis=0) / np.sqrt(counts)[:, None], feats, begin

    def potentials(self, scores: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0))


def _chains(texts: list[bytes]) -> tuple[Words, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of lower-cased texts; number of each among the distinct ones; these; texts that have words; their lengths."""
    words = Words(texts, LETTERS, lower=False)
    _, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    counts = words.counts()
    some = np.flatnonzero(counts)
    return words, number, [words.word(i) for i in first.tolist()], some, counts[some]


def fit(texts: list[bytes], labels: list[str]) -> Field:
    """Stochastic gradient ascent on the likelihood of each text's words all having its label, switches between joined texts."""
    langs = sorted(set(labels))
    n = len(langs)
    field = Field(langs, np.zeros((1 << FEATURE_BITS, n)), np.zeros((n, n)), np.zeros(n))
    seen = np.full((1 << FEATURE_BITS, n), 1e-2)
    label = np.array([langs.index(x) for x in labels])
    order = np.random.default_rng(7).permutation(len(texts))
    for _ in range(EPOCHS):
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            _, number, distinct, some, lengths = _chains([texts[i] for i in rows])
            if not len(some):
                continue
            scores, feats, begin = field.emissions(distinct)
            of_word = np.repeat(label[rows][some], lengths)
            ends = np.cumsum(lengths)
            joined = np.arange(len(lengths)) % PAIR_OF == 0  # with the next one
            lengths = np.diff(np.append(0, ends[~joined | (np.arange(len(ends)) == len(ends) - 1)]))
            chains = Chains(lengths)
            by_step = np.empty(len(number), dtype=np.int64)
            by_step[chains.place] = number
            truth = np.empty(len(number), dtype=np.int64)
            truth[chains.place] = of_word
            post, moves, _ = chains.posteriors(field.potentials(scores)[by_step], np.exp(field.move), np.exp(field.first))
            diff = -post
            diff[np.arange(len(truth)), truth] += 1
            by_word = np.stack([np.bincount(by_step, weights=diff[:, k], minlength=len(distinct)) for k in range(n)], axis=1)
            counts = np.diff(np.append(begin, len(feats)))
            spread = np.repeat(by_word / np.sqrt(counts)[:, None], counts, axis=0)
            step = np.stack([np.bincount(feats, weights=spread[:, k], minlength=len(seen)) for k in range(n)], axis=1) / len(rows)
            hit = np.flatnonzero(step.any(axis=1))
            seen[hit] += step[hit] ** 2
            field.weight[hit] += RATE * (step[hit] / np.sqrt(seen[hit]) - DECAY * field.weight[hit])
            real = np.zeros((n, n))
            inner = np.ones(len(of_word), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False  # words with one before them in their chain
            np.add.at(real, (of_word[np.flatnonzero(inner) - 1], of_word[inner]), 1)
            field.move = np.clip(field.move + 0.5 * (real - moves) / max(1, lengths.sum()), -4, 4)
            first = np.bincount(of_word[np.cumsum(lengths) - lengths], minlength=n) - post[: len(lengths)].sum(axis=0)
            field.first = np.clip(field.first + 0.1 * first / len(rows), -4, 4)
    field.weight = field.weight.astype(np.float32)
    return field


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Field | None:
    """Fit to at most `rows` rows with a text and a label, those with the smallest hash of their id and text."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    got = drawn(d.filter("text is not null and lang is not null"), rows, "id", "text").toPandas().sort_values(["id", "text", "lang"])
    return fit([t.lower().encode() for t in got["text"]], got["lang"].tolist()) if len(got) else None


def _stretches(cut: np.ndarray, number: np.ndarray, potentials: np.ndarray, words: int) -> Iterator[tuple[int, int, Chains, np.ndarray]]:
    """(first, end, layout, potentials by step) of as many stretches at a time as have about so many words."""
    ends, a = np.cumsum(cut), 0
    while a < len(cut):
        base = int(ends[a] - cut[a])
        b = max(a + 1, int(np.searchsorted(ends, base + words, side="right")))
        chains = Chains(cut[a:b])
        by_step = np.empty(int(ends[b - 1]) - base, dtype=np.int64)
        by_step[chains.place] = number[base : ends[b - 1]]
        yield a, b, chains, potentials[by_step]
        a = b


def _borders(cut: np.ndarray, parts: np.ndarray, number: np.ndarray, potentials: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each stretch and what follows it, so that stretches of a text are looked through side by side as one chain.

    The stretches of long texts are first summed up as matrices, from the label before to the last one; their products carry
    forward and backward weights over the cuts.
    """
    begin, end = np.tile(first, (len(cut), 1)), np.ones((len(cut), len(first)))
    stop = np.cumsum(parts)
    many = np.flatnonzero(parts > 1)
    if not len(many):
        return begin, end
    long = np.repeat(parts > 1, parts)
    heads = np.zeros(len(cut), dtype=bool)
    heads[stop[many] - parts[many]] = True
    across = np.ones((len(cut), len(first), len(first)))
    across[long & ~heads] = np.concatenate([c.transfers(emit, move) for _, _, c, emit in _stretches(cut[long & ~heads], number[np.repeat(long & ~heads, cut)], potentials, STEP_WORDS)])
    after = np.ones((len(cut), len(first)))
    after[heads] = np.concatenate([c.forward(emit, move, first)[0][c.place[np.cumsum(c.lengths) - 1]] for _, _, c, emit in _stretches(cut[heads], number[np.repeat(heads, cut)], potentials, STEP_WORDS)])
    for t in many.tolist():
        mine = range(stop[t] - parts[t], stop[t])
        now = after[mine[0]]
        for k in mine[1:]:
            begin[k] = now @ move
            now = now @ across[k]
            now = now / now.sum()
        for k in reversed(mine[:-1]):
            back = across[k + 1] @ end[k + 1]
            end[k] = back / back.sum()
    return begin, end


def label(texts: list[str | None], field: Field | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if field is None:
        return lang, score
    lower = [t.lower().encode() if t else b"" for t in texts]
    _, number, distinct, some, lengths = _chains(lower)
    if not len(some):
        return lang, score
    scores, _, _ = field.emissions(distinct)
    potentials, move, first = field.potentials(scores), np.exp(field.move), np.exp(field.first)
    # stretches of CHAIN_WORDS words at most, and about as many words at a time
    parts = -(-lengths // CHAIN_WORDS)
    starts = np.concatenate([np.arange(k) * CHAIN_WORDS for k in parts.tolist()])
    owner = np.repeat(np.arange(len(lengths)), parts)
    cut = np.minimum(CHAIN_WORDS, lengths[owner] - starts)
    begin, end = _borders(cut, parts, number, potentials, move, first)
    total = np.zeros((len(lengths), len(field.langs)))
    for a, b, chains, emit in _stretches(cut, number, potentials, STEP_WORDS):
        post, _, _ = chains.posteriors(emit, move, begin[a:b], pairs=False, end=end[a:b])
        post /= post.sum(axis=1, keepdims=True)
        np.add.at(total, owner[a:b], np.add.reduceat(post[chains.place], np.cumsum(cut[a:b]) - cut[a:b], axis=0))
    mean = total / lengths[:, None]
    for i, k, s in zip(some.tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
        if lower[i].upper() != lower[i] or any(map(str.isalpha, texts[i])):
            lang[i], score[i] = field.langs[k], min(1.0, s)
    return lang, score


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, limit=1 << 19):
            lang, score = label(part.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # FEATURE_BITS bounds its size
    return d.mapInArrow(lean(lambda it: _predict(it, shared)), f"doc_id {kind}, lang_pred string, score double")


def _keep(batches: Iterator[pa.RecordBatch], shared, text: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, text, 1 << 19):
            lang, score = label(part.column(text).to_pylist(), shared.value)
            yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score.tolist(), strict=True)]))


def keep_known(docs: DataFrame, field: Field | None, text_col: str = "text", least: float = KEEP_SCORE) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.mapInArrow(lean(lambda it: _keep(it, shared, text_col, least)), docs.schema)

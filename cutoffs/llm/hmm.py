"""Language model scoring with a hidden Markov model trained by Baum-Welch over the whole training corpus.

Tokens are the words of a lower-cased (A-Z) text and one end. The most frequent training words, about `top_words` of them,
are symbols of their own; any other word is the symbol of its class (a hash of its ending) times its share of the class,
from exact corpus counts with add-half smoothing. So the tables that every task needs have a fixed size, while the counts
of all words stay in a Spark table that is joined by word. With `top_words` of the size of the vocabulary every training
word is a symbol of its own, and the model has no classes but for unknown words. Expected counts of emissions and moves
are computed per task by forward-backward and summed by Spark; a text's score is the scaled forward recursion over its
symbols plus the shares.

Before the passes over the corpus the parameters are set by a few rounds on at most WARM_DOCS texts (the ones with the
smallest hash). All counts cover every training text, and passes over all of them follow until one raises the
log-likelihood by less than TOLERANCE of it (or MOST_PASSES).

Defined results: a null text is empty (an end only); a null id is in the training part; repeated rows count and are
scored one by one; with an empty training part the model is uniform; an empty table gives an empty result; a text of more
than LONG tokens is trained as several sequences, and scored as one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.chain import Chains
from cutoffs.llm.common import SPACED, Words, drawn, lean, mixed, raw, remainder, steps
from cutoffs.session import materialize

STATES = 8
TOP_WORDS = 49152
CLASSES = 4096
#: Passes over the corpus, at most, and the share of the log-likelihood under which a gain ends them.
MOST_PASSES, TOLERANCE = 20, 0.002
#: Tokens of a sequence in training, and of a step in scoring.
LONG = 200_000
WARM_DOCS, WARM_ROUNDS = 1000, 12
SMOOTHING = 0.1


def word_class(words: Words) -> np.ndarray:
    """Class of each word: a hash of its last two bytes and of whether it is shorter than that."""
    last = words.buf[words.end - 1].astype(np.uint64)
    short = words.end - words.start < 2
    before = np.where(short, 0, words.buf[np.maximum(words.end - 2, 0)]).astype(np.uint64)
    return (mixed(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, n) summed over about 3 MB of texts at a time; the end is word 0 of class -1."""
    for batch in batches:
        for part in steps(batch, limit=3 << 20):
            words = Words(raw(part.column(0)), SPACED)
            w, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            kind = word_class(words)[first] if len(first) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([_signed(np.append(w, np.uint64(0))), pa.array(np.append(kind, -1)), pa.array(np.append(n, part.num_rows))], names=["word", "class", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, n): occurrences of each word (by hash) and of the end in all texts."""
    part = texts.mapInArrow(_counts, "word bigint, class bigint, n bigint")
    return part.groupBy("word", "class").agg(F.sum("n").alias("n"))


class Lexicon:
    """The fixed-size part of the vocabulary: top words with counts, classes with their sizes, corpus totals."""

    def __init__(self, top: np.ndarray, top_n: np.ndarray, class_n: np.ndarray, class_v: np.ndarray, total: int, distinct: int):
        order = np.argsort(top)
        self.top, self.top_n = top[order], top_n[order]
        self.class_n, self.class_v, self.total, self.distinct = class_n, class_v, total, distinct
        self.end_n = 0
        #: Symbols: the top words, the classes, the end.
        self.n_top = len(self.top)
        self.symbols_n = self.n_top + len(class_n) + 1
        self.kind = "<u2" if self.symbols_n <= 1 << 16 else "<u4"

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each word, flag of each rare word)."""
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, words.hash), len(self.top) - 1)
            rare = self.top[at] != words.hash
        else:
            at, rare = np.zeros(len(words.hash), dtype=np.int64), np.ones(len(words.hash), dtype=bool)
        return np.where(rare, self.n_top + word_class(words), at), rare


def lexicon(counts: DataFrame, top_words: int = TOP_WORDS) -> Lexicon:
    """Collects the counts of at most top_words words and one row per class: tables of bounded size.

    Words are counted by the size of their counts, in 64 steps for each doubling; all words from some step on are taken.
    """
    step = F.floor(F.log2("n") * 64)
    words = counts.filter("class >= 0").withColumn("step", step)
    at, held, least = words.groupBy("step").agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect(), 0, 1 << 20
    for r in at:  # 64 rows for each doubling of the largest count
        held += r["v"]
        if held > top_words:
            break
        least = r["step"]
    top = words.filter(F.col("step") >= least).select("word", "class", "n").toPandas()
    all_of = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    per = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    class_n[per["class"].to_numpy()], class_v[per["class"].to_numpy()] = per["n"], per["v"]
    np.subtract.at(class_n, top["class"].to_numpy(), top["n"].to_numpy())
    np.subtract.at(class_v, top["class"].to_numpy(), 1)
    out = Lexicon(top["word"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64), class_n, class_v, int(all_of["n"] or 0), int(all_of["v"]))
    end = counts.filter("class = -1").agg(F.sum("n")).first()[0]
    out.end_n = int(end or 0)
    return out


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lex: Lexicon = shared.value
    row = TaskContext.get().partitionId() << 40
    logs = np.log10(lex.top_n + 0.5)
    norms = np.log10(lex.class_n + 0.5 * (lex.class_v + 1))
    for batch in batches:
        for part in steps(batch, limit=2 << 20):
            words = Words(raw(part.column(2)), SPACED)
            sym, rare = lex.symbols(words)
            n, counts = part.num_rows, words.counts()
            known = np.bincount(words.doc[~rare], minlength=n)
            base = np.bincount(words.doc[~rare], weights=logs[sym[~rare]], minlength=n)
            norm = np.bincount(words.doc[rare], weights=norms[sym[rare] - lex.n_top], minlength=n)
            ends = np.cumsum(counts)
            data = np.insert(sym, ends, lex.symbols_n - 1).astype(lex.kind).tobytes()
            at = np.append(0, np.cumsum(counts + 1)) * np.dtype(lex.kind).itemsize
            # each distinct rare word of a text once, with its count
            key = np.rec.fromarrays([words.doc[rare], words.hash[rare]])
            order = np.lexsort((key.f1, key.f0))
            key = key[order]
            new = np.append(True, (key.f0[1:] != key.f0[:-1]) | (key.f1[1:] != key.f1[:-1])) if len(key) else np.zeros(0, dtype=bool)
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(key)))
            cut = np.append(np.searchsorted(key.f0[begin], np.arange(n)), len(begin)).astype(np.int32)
            items = pa.StructArray.from_arrays([_signed(np.ascontiguousarray(key.f1[begin])), pa.array(times.astype(np.int32))], names=["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    part.column(0),
                    part.column(1),
                    pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array(known.astype(np.int64)),
                    pa.array(base.astype(np.float64)),
                    pa.array(norm.astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(cut), items),
                ],
                names=["row", "doc_id", "held_out", "sym", "known", "base", "norm", "rare"],
            )
            row += n


class Model:
    """Start, move and emission probabilities (symbols by states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of (start, move, emission) over the sequences, and their log-likelihood."""
        chains = Chains(np.array([len(s) for s in sequences]))
        sym = np.concatenate(sequences)
        by_step = np.empty(len(sym), dtype=np.int64)
        by_step[chains.place] = sym
        post, moves, scale = chains.posteriors(self.emit[by_step], self.move, self.start)
        emit = np.stack([np.bincount(by_step, weights=post[:, k], minlength=len(self.emit)) for k in range(post.shape[1])], axis=1)
        return post[: len(sequences)].sum(axis=0), moves, emit, float(np.log(scale).sum())

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each sequence of symbols; long ones are gone through in steps."""
        out = np.zeros(len(sequences))
        short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
        if short:
            chains = Chains(np.array([len(sequences[i]) for i in short]))
            by_step = np.empty(len(chains.place), dtype=np.int64)
            by_step[chains.place] = np.concatenate([sequences[i] for i in short])
            _, scale = chains.forward(self.emit[by_step], self.move, self.start)
            out[short] = chains.log_likelihood(scale)
        for i in set(range(len(sequences))) - set(short):
            start = self.start
            for a in range(0, len(sequences[i]), LONG):
                part = sequences[i][a : a + LONG]
                alpha, scale = Chains(np.array([len(part)])).forward(self.emit[part], self.move, start)
                out[i] += np.log(scale).sum()
                start = alpha[-1] @ self.move
        return out / np.log(10)

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        start, move = start + 1, move + 1
        emit = emit + SMOOTHING * len(emit) * prior[:, None] + 1e-6
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _grouped(seqs: Iterator[np.ndarray], most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Sequences in groups of about 300,000 symbols; with `most`, longer ones in parts."""
    out, held = [], 0
    for seq in seqs:
        for a in range(0, len(seq), most or len(seq)):
            out.append(seq[a : a + (most or len(seq))])
            held += len(out[-1])
            if held > 300_000:
                yield out
                out, held = [], 0
    if out:
        yield out


def _sequences(col: pa.Array, kind: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The symbol sequences of a column, longest first, and their places in it: a group takes as many steps as its longest."""
    seqs = [np.frombuffer(x.as_buffer(), dtype=kind) for x in col]
    order = np.argsort([-len(x) for x in seqs], kind="stable")
    return [seqs[i] for i in order.tolist()], order


def _expect(batches: Iterator[pa.RecordBatch], shared, kind: str) -> Iterator[pa.RecordBatch]:
    """Expected counts of one task: rows of emissions by symbol, of moves (-1 - state), starts (-1 - states), and likelihood."""
    model: Model = shared.value
    n = len(model.start)
    start, move, emit, like = np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape), np.zeros(n)
    for batch in batches:
        for seqs in _grouped(iter(_sequences(batch.column(0), kind)[0]), LONG):
            s, m, e, x = model.expected(seqs)
            start, move, like[0] = start + s, move + m, like[0] + x
            emit += e
    some = np.flatnonzero(emit.any(axis=1))
    if len(some):
        names = np.concatenate((some, -1 - np.arange(n), [-1 - n, -2 - n]))
        rows = np.concatenate((emit[some], move, start[None], like[None]))
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(n)]], names=["name", *[f"s{k}" for k in range(n)]])


def _unpack(rows, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    n = len(model.start)
    start, move, emit, like = np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape), 0.0
    names, values = rows["name"].to_numpy(), rows[[f"s{k}" for k in range(n)]].to_numpy()
    emit[names[names >= 0]] = values[names >= 0]
    for name, value in zip(names[names < 0].tolist(), values[names < 0], strict=True):
        if name >= -n:
            move[-1 - name] = value
        elif name == -1 - n:
            start = value
        else:
            like = float(value[0])
    return start, move, emit, like


def baum_welch(coded: DataFrame, lex: Lexicon, passes: int = MOST_PASSES, tolerance: float = TOLERANCE, states: int = STATES) -> Model:
    """Train on the `sym` column of coded: first on a bounded set on the driver, then over all rows until it hardly gains."""
    prior = np.concatenate((lex.top_n, lex.class_n, [lex.end_n])) + 0.5
    prior = prior / prior.sum()
    noise = np.random.default_rng(11).gamma(1.0, size=(len(prior), states))
    emit = prior[:, None] * (0.2 + noise)
    model = Model(np.full(states, 1 / states), (np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)), emit / emit.sum(axis=0))
    warm = drawn(coded.select("sym"), WARM_DOCS, "sym").toPandas()["sym"]
    seqs = [np.frombuffer(x, dtype=lex.kind) for x in sorted(map(bytes, warm))]
    for _ in range(WARM_ROUNDS if seqs else 0):
        parts = [model.expected(p) for p in _grouped(iter(seqs), LONG)]
        model = Model.from_counts(*[sum(x[k] for x in parts) for k in range(3)], prior)
    sums, last = [F.sum(f"s{k}").alias(f"s{k}") for k in range(states)], None
    for _ in range(passes if seqs else 0):
        shared = coded.sparkSession.sparkContext.broadcast(model)  # symbols x states numbers
        part = coded.select("sym").mapInArrow(lean(lambda it, s=shared: _expect(it, s, lex.kind)), "name bigint, " + ", ".join(f"s{k} double" for k in range(states)))
        *counts, like = _unpack(part.groupBy("name").agg(*sums).toPandas(), model)
        shared.destroy()
        model = Model.from_counts(*counts, prior)
        if last is not None and like - last < tolerance * abs(last):
            break
        last = like
    return model


def _forward(batches: Iterator[pa.RecordBatch], shared, kind: str) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        seqs, order = _sequences(batch.column(3), kind)
        chain = np.zeros(len(seqs))
        chain[order] = np.concatenate([np.zeros(0), *[model.log10(group) for group in _grouped(iter(seqs))]])
        sizes = [len(x) // np.dtype(kind).itemsize for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), batch.column(4), batch.column(5), batch.column(6), pa.array(chain)], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "norm", "chain"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 1, top_words: int = TOP_WORDS, passes: int = MOST_PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32(id) modulo `modulus` is `held` are scored but not learnt from.
    """
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), modulus) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(word_counts(d.filter("not held_out").select("text")))
    lex = lexicon(counts, top_words)
    kind = d.schema["doc_id"].dataType.simpleString()
    shared = sc.broadcast(lex)  # top_words and CLASSES bound its size
    coded = materialize(d.mapInArrow(lean(lambda it: _encode(it, shared)), f"row bigint, doc_id {kind}, held_out boolean, sym binary, known bigint, base double, norm double, rare array<struct<word: bigint, times: int>>"))
    model = baum_welch(coded.filter("not held_out"), lex, passes)
    fit = sc.broadcast(model)
    scored = coded.select("row", "doc_id", "held_out", "sym", "known", "base", "norm").mapInArrow(lean(lambda it: _forward(it, fit, lex.kind)), f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, norm double, chain double")
    # counts of rare words: joined by word, summed by row
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(counts.filter("class >= 0").select("word", "n"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"),
    )
    total = lex.total + 0.5 * (lex.distinct + 1)
    end = float(np.log10(lex.end_n + 0.5))
    out = scored.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rare_known", "rare_base")})
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known") + F.lit(1 if lex.end_n else 0)).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base") + end - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (F.col("chain") + F.col("rare_base") - F.col("norm")).alias("score"),
    )

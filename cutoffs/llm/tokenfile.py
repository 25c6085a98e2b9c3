"""Token ids in compressed shards: Re-Pair grammars with expansion lengths for random access.

Documents are put in ascending order of their id and encoded with a byte-level BPE file of the tokenizers library; the
end id follows each document. Every SHARD_TOKENS ids (rounded up to whole documents) make a shard. In rounds, the most
frequent adjacent pairs of a shard become nonterminals and replace their non-overlapping occurrences, left to right,
until no pair occurs so often that its rule is paid for. A shard's payload holds the rules, the length of what each rule
expands to, and the remaining sequence in fixed-width bits; with the running sum of lengths, any range of ids is decoded
from the symbols that cover it, without the rest of the shard.

Payload (little-endian): magic "RPR1", then 32-bit numbers: base (first nonterminal id), rules, symbols, bits, ids; then
the rules as pairs of 32-bit numbers, their expansion lengths as 32-bit numbers, and the symbols packed into `bits` bits
each. A shard is one row of a Parquet table, with the ids and sizes of its documents.

Defined results: a null text is empty (an end id only); a null id comes first; repeated ids are ordered by a hash of
their text; an empty table gives an empty table of shards; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.llm.common import Kept, lean, raw, steps
from cutoffs.session import materialize

END_ID = 2
SHARD_TOKENS = 1_000_000
#: Bits that a rule takes in a payload; a round replaces pairs down to 1 / SHARE of the most frequent one's count.
RULE_BITS, SHARE = 96, 8
#: Pieces of a generation that a task keeps encoded; there are two at most.
CACHE_WORDS = 500_000
_HASH_BITS = 18


class ByteBpe:
    """A byte-level BPE file of the tokenizers library; stretches between safe cuts are encoded once and kept.

    The library's pre-tokenizer always begins a piece where white space follows something else, at a space before something
    else than white space, and at punctuation (but ') after a letter or digit, so a text can be cut there. Cuts are made where
    ASCII bytes tell it. The stretches of many texts are found and told apart as arrays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.heads = sorted({t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        # a character of a byte-level token stands for a byte
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], dtype=np.int64)
        self.kept = Kept(CACHE_WORDS)

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)] if texts else []

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces, of those that begin with one white space and end with none many as one text: no token goes beyond
        its piece, so bytes tell them apart."""
        words = [p.decode() for p in pieces]
        joint = [k for k, w in enumerate(words) if len(w) > 1 and w[0] in " \n" and not w[1].isspace() and not w[-1].isspace()]
        for a in range(0, len(joint), 200):
            part = [pieces[k] for k in joint[a : a + 200]]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(list(map(len, part))))
            data, ends = ids.tobytes(), (4 * (stops + 1)).tolist()
            self.kept.young.update(zip(part, [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        alone = list(set(pieces).difference(map(pieces.__getitem__, joint)))
        self.kept.young.update(zip(alone, self._whole(alone), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian 32-bit integers."""
        # a text in which an added token may stand goes through the library as a whole
        special = [i for i, t in enumerate(texts) if any(h in t for h in self.heads)]
        plain = list(texts)
        for i in special:
            plain[i] = b""
        ends = np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))
        buf = np.frombuffer(b"".join(plain), dtype=np.uint8)
        if len(buf):
            at = _cuts(buf, ends)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
            which, names = pieces.indices.to_numpy(), _slices(pieces.dictionary)
            kinds = list(map(self.kept.young.get, names))
            if None in kinds:
                self._learn(list(self.kept.missing({p for p, x in zip(names, kinds, strict=True) if x is None})))
                kinds = [self.kept.young[p] if x is None else x for p, x in zip(names, kinds, strict=True)]
            size = np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds)) >> 2
            begin = np.cumsum(size) - size
            flat, size, begin = np.frombuffer(b"".join(kinds), dtype="<u4"), size[which], begin[which]
            upto = np.append(0, np.cumsum(size))
            ids = flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])].tobytes()
            stop = (4 * upto[np.searchsorted(at, ends)]).tolist()
            out = [ids[x:y] for x, y in zip([0, *stop], stop, strict=False)]
        else:
            out = [b""] * len(texts)
        for i, x in zip(special, self._whole([texts[i] for i in special]), strict=True):
            out[i] = x
        return out


def _slices(col: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls or offset."""
    _, ends, data = col.buffers()
    ends, data = np.frombuffer(ends, dtype=np.int64)[: len(col) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


#: Classes of bytes: 1 ASCII letters and digits, 2 ASCII punctuation but ', 3 ', 4 white space (and what may be some), 0 others.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 3
_KIND[[*range(9, 14), *range(28, 33)]] = 4


def _cuts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places in the bytes of texts that end at `ends` where a stretch begins: those of the texts and the safe ones in them."""
    kind = _KIND[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    seen = (kind[:-1] > 0) & (kind[:-1] < 4)  # white space after this begins a piece, and punctuation after a letter or digit
    cut[1:-1] = seen & (kind[1:] == 4) & (buf[1:] < 14) | (kind[1:] == 2) & (kind[:-1] == 1)
    space = np.flatnonzero(buf[:-1] == 32)
    nxt, after = buf[space + 1], np.append(buf, 0)[space + 2]
    wide = (nxt == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (nxt == 0xE1) & (after == 0x9A) | (nxt == 0xE2) & ((after == 0x80) | (after == 0x81)) | (nxt == 0xE3) & (after == 0x80)
    last = np.zeros(len(buf) + 1, dtype=bool)
    last[ends] = True
    cut[space[(kind[space + 1] != 4) & ~wide & ~last[space + 1]]] = True
    cut[ends] = True
    cut[0] = True
    return np.flatnonzero(cut[:-1])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def paying(base: int) -> int:
    """Occurrences from which a rule is shorter than what it saves: each saves one symbol of as many bits as base has."""
    return RULE_BITS // max(1, base.bit_length()) + 1


def re_pair(ids: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules, base): rule k is the pair that nonterminal base + k stands for.

    Pairs are counted by slots of a hash first, and exactly where a slot is frequent; pairs in a run of one symbol count
    without overlap. Each round replaces the pairs that occur at least 1 / SHARE as often as the most frequent slot, or,
    if there is none, those that occur `least` times (by default, those whose rule pays). It ends when no pair does. Of pairs
    that are in each other's way a rule may keep down to half of that; to wait with it for a round of its own takes four
    times as long and makes shards 0.3 % smaller.
    """
    base = int(ids.max(initial=0)) + 1
    least = max(2, paying(base) if least is None else least)
    seq, rules, n_rules, alone, all_ = ids.astype(np.uint32), [], 0, False, False
    lut = np.empty(1 << _HASH_BITS, dtype=np.int32)
    while len(seq) > least:
        a, b = seq[:-1], seq[1:]
        slot = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASH_BITS)).astype(np.int64)
        # a pair is not more frequent than its slot, so only the places of frequent slots need exact counts
        total = np.bincount(slot, minlength=1 << _HASH_BITS)
        enough = least if all_ else max(least, int(total.max()) // SHARE)
        all_ = False
        at = np.flatnonzero((total >= enough)[slot])
        at = at[_every_second(at, a[at] == b[at])]
        key = a[at].astype(np.uint64) << np.uint64(32) | b[at]
        pair, count = _counted(key)
        some = np.flatnonzero(count >= enough)
        if not len(some):
            if enough == least:
                break
            all_ = True
            continue
        some = some[np.argsort(count[some], kind="stable")][-1 if alone else 0 :]
        first, second = (pair[some] >> np.uint64(32)).astype(np.uint32), pair[some].astype(np.uint32)
        # of chosen pairs in one slot the most frequent has it; the others wait for the next round
        lut.fill(-1)
        lut[((first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HASH_BITS)).astype(np.int64)] = np.arange(len(some), dtype=np.int32)
        rule = lut[slot[at]]
        hit = np.flatnonzero((rule >= 0) & (pair[some][rule] == key))
        at, rule = at[hit], rule[hit]
        take = _every_second(at, np.ones(len(at), dtype=bool))
        at, rule = at[take], rule[take]
        used = np.bincount(rule, minlength=len(some)) >= least // 2
        keep = used[rule]
        at, rule = at[keep], rule[keep]
        alone = not len(at)  # where pairs are in each other's way the most frequent one is replaced alone
        if alone:
            continue
        rules.append(np.stack((first[used], second[used]), axis=1))
        seq[at] = (base + n_rules - 1 + np.cumsum(used)).astype(np.uint32)[rule]
        n_rules += int(used.sum())
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq = seq[stay]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32), base


def _every_second(at: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Flags of the places `at` to keep: of those flagged in `among`, every second one in a run of neighbours."""
    out = np.ones(len(at), dtype=bool)
    here = np.flatnonzero(among)
    place, own = np.arange(len(here)), at[here]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1] + 1
    out[here] = ((place - np.maximum.accumulate(np.where(new, place, 0))) & 1) == 0
    return out


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[edge], np.diff(np.append(edge, len(key)))


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to (a rule refers to earlier rules only)."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, dtype=np.uint32)


def pack(ids: np.ndarray, least: int | None = None) -> bytes:
    seq, rules, base = re_pair(ids, least)
    bits = max(1, int(base + len(rules) - 1).bit_length())
    head = np.array([base, len(rules), len(seq), bits, len(ids)], dtype="<u4").tobytes()
    parts = []
    for a in range(0, len(seq), 1 << 16):  # 65536 symbols fill whole bytes
        chunk = seq[a : a + (1 << 16)].astype(">u4").view(np.uint8)
        parts.append(np.packbits(np.unpackbits(chunk).reshape(-1, 32)[:, 32 - bits :].ravel()).tobytes())
    body = b"".join(parts)
    return b"RPR1" + head + rules.astype("<u4").tobytes() + lengths(rules, base).astype("<u4").tobytes() + body


class Grammar:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPR1":
            raise ValueError("not a shard of token ids")
        self.base, n_rules, n_seq, bits, self.n_ids = np.frombuffer(payload, dtype="<u4", count=5, offset=4).astype(np.int64).tolist()
        at = 24
        self.rules = np.frombuffer(payload, dtype="<u4", count=2 * n_rules, offset=at).reshape(-1, 2).astype(np.int64)
        self.length = np.frombuffer(payload, dtype="<u4", count=n_rules, offset=at + 8 * n_rules).astype(np.int64)
        raw = np.append(np.frombuffer(payload, dtype=np.uint8, offset=at + 12 * n_rules), np.zeros(8, dtype=np.uint8))
        bit = np.arange(n_seq, dtype=np.int64) * bits
        byte, word = bit >> 3, np.zeros(n_seq, dtype=np.int64)
        for k in range(5):  # a symbol of at most 32 bits lies in five bytes
            word = (word << 8) | raw[byte + k]
        self.seq = (word >> (40 - bits - (bit & 7))) & ((1 << bits) - 1)
        size = np.ones(n_seq, dtype=np.int64)
        high = self.seq >= self.base
        size[high] = self.length[self.seq[high] - self.base]
        self.ends = np.cumsum(size)
        self.table: np.ndarray | None = None

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of some symbols, copied from a table of what each rule expands to, if that is not out of proportion."""
        if len(seq) < len(self.rules) or self.length.sum() > 4 * self.n_ids:
            return self.opened(seq)
        if self.table is None:
            self.table = self.opened(self.base + np.arange(len(self.rules)))
            self.begin = np.cumsum(self.length) - self.length
        out_at = np.concatenate((seq.astype("<u4"), self.table))
        high = seq >= self.base
        size, start = np.ones(len(seq), dtype=np.int64), np.arange(len(seq))
        rule = seq[high] - self.base
        size[high], start[high] = self.length[rule], len(seq) + self.begin[rule]
        ends = np.cumsum(size)
        return out_at[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]

    def opened(self, seq: np.ndarray) -> np.ndarray:
        """The ids of some symbols; each pass opens all nonterminals by one rule."""
        while True:
            high = seq >= self.base
            if not high.any():
                return seq.astype("<u4")
            place = np.cumsum(1 + high) - 1
            out = np.empty(place[-1] + 1, dtype=np.int64)
            rule = self.rules[seq[high] - self.base]
            out[place[~high]] = seq[~high]
            out[place[high] - 1], out[place[high]] = rule[:, 0], rule[:, 1]
            seq = out

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop, decoded from the symbols that cover them."""
        stop = self.n_ids if stop is None else stop
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        a, b = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, stop - 1, side="right")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.seq[a : b + 1])[start - before : stop - before]


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_tokens: int, least: int | None) -> Iterator[pa.RecordBatch]:
    """Encodes the documents of one range in order and yields a row per shard."""
    bpe, part, number, first, n_held = byte_bpe(path), TaskContext.get().partitionId(), 0, 0, 0
    names: list[pa.Array] = []
    held: list[bytes] = []
    end = np.uint32(end_id).tobytes()

    def flush() -> pa.RecordBatch:
        nonlocal number, first
        sizes = [len(x) // 4 for x in held]
        ids = np.frombuffer(b"".join(held), dtype="<u4")
        docs = pa.concat_arrays(names)
        row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids, least)], pa.binary())]
        number, first = number + 1, first + len(ids)
        return pa.RecordBatch.from_arrays(row, names=["range", "shard", "first", "n_tokens", "doc_ids", "sizes", "payload"])

    for batch in batches:
        for step in steps(batch, limit=6 << 20):
            at = 0
            for k, ids in enumerate(bpe.encode(raw(step.column(1)))):
                held.append(ids + end)
                n_held += len(held[-1])
                if n_held >= 4 * shard_tokens:
                    names.append(step.column(0).slice(at, k + 1 - at))
                    yield flush()
                    names, held, n_held, at = [], [], 0, k + 1
            if at < step.num_rows:
                names.append(step.column(0).slice(at))
    if held:
        yield flush()


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None, least: int | None = None) -> DataFrame:
    """Writes the shards of docs, in ranges of ascending id, and returns the table as read back; least as in `re_pair`.

    Columns: range, shard, first (ids of the range before the shard), n_tokens, doc_ids, sizes, payload.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ordered = d.repartitionByRange(n, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    schema = f"range int, shard int, first bigint, n_tokens bigint, doc_ids array<{kind}>, sizes array<bigint>, payload binary"
    return materialize(ordered.mapInArrow(lean(lambda it: _shards(it, path, end_id, shard_tokens, least)), schema))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            grammar = Grammar(batch.column(3)[k].as_py())
            docs, sizes = batch.column(1).slice(k, 1).flatten(), batch.column(2)[k].as_py()
            ids, ends = grammar.read(), np.cumsum(sizes)
            crc = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(sizes, ends.tolist(), strict=True)]
            start = batch.column(0)[k].as_py() + ends - sizes
            yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def located(shards: DataFrame) -> DataFrame:
    """shards with `start`: the ids of all shards before. A sum over ranges, of which there are as many as partitions."""
    per = shards.groupBy("range").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return shards.join(F.broadcast(per), "range").withColumn("start", F.col("first") + F.col("_before")).drop("_before")


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards' payloads."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    rows = located(shards).select("start", "doc_ids", "sizes", "payload")
    return rows.mapInArrow(lean(_read), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")

"""The ten text operators against plain brute force on small tables, with nulls, repeats, clashing names and no rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cutoffs.llm import bpe, decontam, hmm, langid, linededup, neardup, quality, sharding, simhash, tokenfile, toxicity
from cutoffs.llm.chain import Chains

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, key int, n_lines string"
LONG = " ".join(f"wort{i % 97} ist{i % 13}" for i in range(3000))
PASSAGE = " ".join(f"pass{i}" for i in range(55))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, white, symbol-only, very long and repeated texts."""
    rows = [
        (1, "Ein kurzer Text.\nZweite Zeile hier.", "de", "a", 10, "x", 1, "y"),
        (2, None, None, None, None, None, None, None),
        (None, "no id here at all", "en", "b", 1, "x", 1, "y"),
        (3, "", "en", "a", 0, "x", 1, "y"),
        (4, " \t\n\x0b ", "en", "a", 0, "x", 1, "y"),
        (5, "... !!! ---", "en", "a", 0, "x", 1, "y"),
        (6, LONG, "de", "a", 9, "x", 1, "y"),
        (7, "alpha beta\n" + PASSAGE + "\nomega", "en", "a", 9, "x", 1, "y"),
        (8, "other start\n" + PASSAGE + "\nother end", "en", "a", 9, "x", 1, "y"),
        (8, "other start\n" + PASSAGE + "\nother end", "en", "a", 9, "x", 1, "y"),
        (9, "été <|endoftext|> 日本語 İΣ x  y \n z", "fr", "c", 9, "x", 1, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}


# SimHash -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(rows, bits=4):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [plain_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash_is_brute_force(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == plain_components(rows)


def test_simhash_links_find_all_components(spark):
    """Groups of many near fingerprints, and chains in which only neighbours are near."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).tolist()
    fps = {b for b in base}
    for b in base[:6]:
        for _ in range(40):
            x = b
            for k in rng.integers(0, 64, 4):
                x ^= 1 << int(k)
            fps.add(x)
    x = base[7]
    for k in range(0, 60, 4):
        x ^= 0xF << k
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()}
    want = list(range(len(fps)))
    for _ in fps:
        new = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
        if new == want:
            break
        want = new
    assert got == dict(enumerate(want))


def test_block_masks_cover_every_pair():
    for blocks in (5, 6, 7, 8):
        masks = [m % (1 << 64) for m in simhash.block_masks(blocks, blocks - 4)]
        for bits in ((0, 20, 40, 63), (1, 2, 3, 4), (10, 11, 30, 50)):
            diff = sum(1 << b for b in bits)
            assert any(diff & m == 0 for m in masks)


def test_keep_one(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    kept = Counter(r["doc_id"] for r in simhash.keep_one(odd).collect())
    assert kept == Counter({c for _, _, c in plain_components(rows)})  # one row of each component, that of its smallest id
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(none).count() == 0


def test_pipeline_near_dedup_finds_jaccard_of_four_fifths(spark):
    rng = np.random.default_rng(7)
    rows, sets = [], {}

    def add(d, w):
        rows.append((d, " ".join(w)))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for d in range(200):
        w = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(100, 800))]
        add(d, w)
        copy, share = list(w), rng.uniform(0.003, 0.05)
        for i in np.flatnonzero(rng.random(len(w)) < share):
            copy[i] = f"new{i}"
        add(1000 + d, copy)
    alike = {d: len(sets[d] & sets[1000 + d]) / len(sets[d] | sets[1000 + d]) for d in range(200)}
    near = {1000 + d for d, j in alike.items() if j >= 0.8}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()}
    print(f"near copies {len(near)}, dropped {len(near - kept)}; under 0.8: {200 - len(near)}")
    assert 80 < len(near) < 180 and kept == {d for d, _ in rows} - near


def test_near_dedup_of_a_large_group_is_brute_force(spark):
    """Copies near and far from one text, a far group of its own, chains of which only neighbours are near, other lengths."""
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in rng.integers(0, 900, 150)]

    def changed(w, n, tag):
        w = list(w)
        for i in rng.choice(len(w), n, replace=False):
            w[i] = f"{tag}_{i}"
        return w

    all_ = [base]
    all_ += [changed(base, int(rng.integers(1, 4)), f"a{k}") for k in range(120)]
    all_ += [changed(base, int(rng.integers(4, 12)), f"b{k}") for k in range(80)]
    second = changed(base, 14, "s")
    all_ += [changed(second, 1, f"c{k}") for k in range(40)]
    link = changed(base, 6, "l")
    for k in range(8):
        link = changed(link, 3, f"l{k}")
        all_.append(link)
    all_ += [base[:-k] for k in (5, 20, 31, 45, 46, 47)] + [base + [f"t{k}" for k in range(n)] for n in (4, 25, 60, 61, 62)]
    order = rng.permutation(len(all_))
    rows = [(d, " ".join(all_[k])) for d, k in enumerate(order.tolist())]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    kept = {r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set(root) and len(kept) > 20


def test_sketches_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for k in (0, 1, 7, 60):
            b = np.unique(np.concatenate((a[k:], rng.integers(0, 1 << 62, k).astype(np.uint64))))
            bits = sum(int(x).bit_count() for x in (neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))


# Sharding ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_sharding_is_brute_force(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text", "source").collect()
    by = {}
    for r in rows:
        t = (r["text"] or "").encode()
        size, crc = len(t) + 1, zlib.crc32(t)
        key = hashlib.md5(f"42:{'null' if r['doc_id'] is None else r['doc_id']}:{crc}:{size}".encode()).hexdigest()
        by.setdefault(r["source"], []).append((key, r["doc_id"], size, crc))
    flat = []
    for s, items in by.items():
        for k, it in enumerate(sorted(items, key=lambda x: (x[0], x[1] is not None, x[1] or 0))):
            flat.append(((k + 0.5) / len(items), "" if s is None else "=" + s, it[0], it[1] or -1, it))
    flat.sort(key=lambda x: x[:4])
    n = max(1, len(flat))
    want = Counter()
    for g, (*_, it) in enumerate(flat):
        shard = g * 8 // n
        want[it[1], it[2], it[3], shard, g - -(-shard * n // 8)] += 1
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(df).collect())
    assert got == want


# Quality -----------------------------------------------------------------------------------------------------------


def plain_rules(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_quality_rules_are_brute_force(spark, request, table):
    df = request.getfixturevalue(table)
    trusted = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    got = quality.rules(df, trusted).collect()
    want = Counter((r["doc_id"], *plain_rules(r["text"])) for r in df.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_quality_score_prefers_the_target(spark):
    good = [(i, "the cat sat on the mat and " * 8) for i in range(20)]
    bad = [(100 + i, "zz qq xx yy vv ww " * 8) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    out = quality.rules(df, spark.createDataFrame([(i,) for i in range(10)], "doc_id bigint"), n_buckets=512)
    by = {r["doc_id"]: r["score"] for r in out.collect()}
    assert min(by[i] for i in range(20)) > 0 > max(by[100 + i] for i in range(20))
    assert quality.rules(df, spark.createDataFrame([], "doc_id bigint")).filter("score is not null").count() == 0


def test_quality_score_and_verdict_are_brute_force(spark, docs):
    """Buckets, both multinomials and the mean ratio told again in Python, with ids that are repeated or null."""
    some = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(60).collect()]
    some += [some[0], (None, some[1][1]), (9001, None), (9002, "one"), (9003, "ein zwei")]
    df = spark.createDataFrame(some, "doc_id bigint, text string")
    good = [(d,) for d, _ in some[:40] if d is not None and d % 2 == 0] + [(9002,), (None,), (some[0][0],)]
    n_buckets = 128

    def h64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def grams(text):
        hs = [h64(w.encode()) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        le = [h.to_bytes(8, "little") for h in hs]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        one = [signed(h64(b)) % n_buckets for b in le]
        return one + [signed(h64(b, h64(a))) % n_buckets for a, b in zip(le, le[1:])]

    ids = {d for d, in good if d is not None}
    raw, target = Counter(), Counter()
    for d, t in some:
        raw.update(grams(t))
        target.update(grams(t) if d in ids else [])
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + n_buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + n_buckets)) for b in range(n_buckets)]
    want = Counter()
    for d, t in some:
        g = grams(t)
        score = sum(ratio[b] for b in g) / len(g) if g else None
        failed = plain_rules(t)[-1]
        want[d, None if score is None else round(score, 9), not failed and score >= 0.0] += 1
    got = quality.rules(df, spark.createDataFrame(good, "doc_id bigint"), threshold=0.0, n_buckets=n_buckets).collect()
    assert Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 9), r["kept"]) for r in got) == want


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_quality_target_counts_all_trusted_documents(spark, kind):
    n = 20_400
    df = spark.range(n + 100).selectExpr(f"cast(id as {kind}) as doc_id", "'one two three' as text")
    trusted = spark.range(n).selectExpr("id as doc_id")
    for block in (quality.BLOCK_IDS, 3000):
        counts = quality.bucket_counts(df, trusted, n_buckets=64, block_ids=block).agg(F.sum("raw"), F.sum("target")).first()
        assert tuple(counts) == (5 * (n + 100), 5 * n)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id % 3 = 0").select("doc_id")
    one, many = (sorted(tuple(r) for r in quality.bucket_counts(docs, some, block_ids=b).collect()) for b in (quality.BLOCK_IDS, 7))
    assert one == many


# Line dedup --------------------------------------------------------------------------------------------------------


def plain_runs(rows, least=50):
    """Lines that are in a run of `least` words or more that any earlier place has: longest runs over all pairs of places."""
    lines = {d: [(k, x) for k, x in enumerate((t or "").split("\n")) if x.split()] for d, t in sorted(rows)}
    size = {d: [len(x.split()) for _, x in a] for d, a in lines.items()}
    gone = {d: set() for d in lines}
    at = {}
    for d, a in lines.items():
        for i, (_, x) in enumerate(a):
            for d0, j in at.setdefault(x, []):
                b, n = lines[d0], 0
                while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                    n += 1
                if sum(size[d][i : i + n]) >= least:
                    gone[d] |= set(range(a[i][0], a[i + n - 1][0] + 1))
            at[x].append((d, i))
        for (p, _), (q, _) in zip(a, a[1:]):
            if {p, q} <= gone[d]:
                gone[d] |= set(range(p, q))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def test_line_dedup_is_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"w{rng.integers(1000)}" for _ in range(rng.integers(1, 70))) for _ in range(40)]
    rows = []
    for d in range(60):
        ls = [pool[k] for k in rng.integers(0, 40, rng.integers(1, 6))]
        if d % 3 == 0:
            ls += ["", *pool[5:9], f"end {d}"]
        rows.append((d, "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.clean(df).collect()}
    # the order of documents with one id and of equal ids is the operator's; ids are distinct here
    assert got == plain_runs(rows)


def test_line_dedup_on_odd_rows(odd, none):
    out = linededup.clean(odd, report=True)
    by = {(r["doc_id"], r["n_removed"]) for r in out.collect()}
    assert (8, 1) in by and (7, 0) in by and out.count() == odd.count()
    assert linededup.clean(odd).columns == odd.columns and linededup.clean(none).count() == 0
    assert {r["n_lines"] for r in linededup.clean(odd).select("n_lines").collect()} == {"y", None}


def test_line_dedup_on_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["text"] for r in linededup.clean(docs).collect()} == plain_runs(rows)


def test_line_dedup_compares_with_every_earlier_place(spark):
    tail, head = "a tail of a few words", "a head of a few words"
    rows = [(0, f"{PASSAGE}\nx"), (1, f"{head}\n{PASSAGE}\n{tail}"), (2, f"{head}\n{PASSAGE}\n{tail}"), (3, f"{PASSAGE}\n\n{tail}\nend")]
    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{k}_{i}" for i in range(rng.integers(2, 30))) for k in range(6)]
    rows += [(10 + d, "\n".join(pool[k] for k in rng.integers(0, 6, rng.integers(2, 14)))) for d in range(40)]
    got = {r["doc_id"]: r["text"] for r in linededup.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain_runs(rows) and got[2] == "" and got[3] == "end"


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_on_partly_shared_tails(spark, seed):
    """Runs with tails that only some places share, short lines everywhere, one line many times over."""
    rng = np.random.default_rng(seed)
    pool = ["ok", "go on", " ".join(f"long{i}" for i in range(60))] + [" ".join(f"w{k}_{i}" for i in range(rng.integers(1, 26))) for k in range(9)]
    base = [pool[k] for k in rng.integers(0, len(pool), 40)]
    rows = []
    for d in range(70):
        a, n = rng.integers(0, 30), rng.integers(1, 12)
        b, m = rng.integers(0, 30), rng.integers(0, 8)
        rows.append((d, "\n".join([*base[a : a + n], *["", pool[int(rng.integers(len(pool)))]] * int(rng.integers(0, 3)), *base[b : b + m]])))
    rows += [(100, "\n".join(["same words here"] * 60)), (101, None), (102, ""), (103, "\n \n")]
    got = {r["doc_id"]: r["text"] for r in linededup.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain_runs(rows)


def test_winnowing_selects_few_lines_and_misses_no_run(spark):
    """Windows of many short lines share their smallest line; a run of min_words words always holds a selected one."""
    rng = np.random.default_rng(9)
    rows = [(d, "\n".join(f"a{x} b{x} c" for x in rng.integers(0, 10_000, 400))) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("__ld_doc", linededup._key("doc_id", "text"))
    found = linededup.windows(linededup.line_table(df))
    picked = found.filter("new").count()
    assert found.count() == 8000 and picked < 8000 * 0.2  # two of about 18 lines by theory


# Decontamination ---------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_report(text, items, window=10):
    w = WORD.findall((text or "").encode().lower())
    hit, found = set(), set()
    for name, t in items:
        v = WORD.findall((t or "").encode().lower())
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(name)
    names = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


@pytest.mark.parametrize("block_words", [200_000, 100])
@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_decontamination_is_brute_force(spark, request, table, block_words):
    df = request.getfixturevalue(table)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "ein KURZER text"), (901, "kurzer"), (902, PASSAGE), (903, None), (904, ""), (None, "other start"), (900, "ein KURZER text")], "item_id bigint, text string")
    both = items.select("item_id", "text").union(extra)
    known = [(r["item_id"], r["text"]) for r in both.collect()]
    found = decontam.find(df, both, block_words=block_words)
    got = Counter((r["doc_id"], r["n_words"], len(r["hit"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect())
    assert got == Counter((r["doc_id"], *plain_report(r["text"], known)) for r in df.select("doc_id", "text").collect())


def test_decontamination_cuts_all_spans(spark, odd):
    items = spark.createDataFrame([(1, PASSAGE), (2, "kurzer text zweite")], "item_id bigint, text string")
    out = decontam.clean(odd, items)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 7 not in left and 8 not in left  # most of their words are the passage
    assert left[1] == "Ein  Zeile hier." and left[6] == LONG and out.columns == odd.columns
    assert decontam.report(out, items).filter("contaminated").count() == 0
    assert decontam.clean(odd, items.limit(0)).count() == odd.count()


def test_decontamination_cuts_the_united_hits_of_all_blocks(spark):
    items = [(k, " ".join(f"i{k}_{j}" for j in range(20))) for k in range(40)]
    # items that overlap, and one whose window only comes together after a cut of another
    items += [(100 + k, " ".join(f"o{j}" for j in range(k, k + 14))) for k in range(0, 60, 4)]
    items += [(200 + k, " ".join(f"t{k}_{j}" for j in range(12))) for k in range(20)]
    own = lambda d, n: " ".join(f"d{d}_{j}" for j in range(n))
    rows = [(k, f"{items[k][1]} {own(k, 26)} {items[k + 7][1]}") for k in range(30)]
    rows += [(100 + k, f"{own(100 + k, 90)} " + " ".join(f"o{j}" for j in range(k, k + 30))) for k in range(20)]
    rows += [(200 + k, f"{own(200 + k, 60)} " + " ".join(f"t{k}_{j}" for j in range(6)) + f" {items[k][1]} " + " ".join(f"t{k}_{j}" for j in range(6, 12))) for k in range(20)]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (texts(decontam.clean(df, bench, block_words=b)) for b in (200_000, 100))
    assert one == many and {d for d, _ in one} == {d for d, _ in rows if d >= 100}
    assert all("t" not in t and "i" not in t for d, t in one if d >= 200)


@pytest.mark.parametrize("block_words", [1, 3, 100])
def test_decontamination_of_odd_rows_is_the_same_in_any_blocks(spark, odd, block_words):
    """Repeated rows, null ids, null texts and items, items without words; other columns stay."""
    items = spark.createDataFrame([(1, PASSAGE), (2, "kurzer text zweite"), (None, "no id here"), (2, "kurzer text zweite"), (3, None), (4, "..."), (5, "wort1 ist1 wort2")], "item_id bigint, text string")
    want = Counter(map(tuple, decontam.clean(odd, items).collect()))
    assert Counter(map(tuple, decontam.clean(odd, items, block_words=block_words).collect())) == want
    assert decontam.clean(odd.limit(0), items, block_words=block_words).count() == 0


# BPE ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_bpe_is_the_library(request, table):
    df = request.getfixturevalue(table)
    path = P.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        data = np.array(ids, dtype="<u4").tobytes()
        want[r["doc_id"], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(df, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_bpe_round_trip_of_ids():
    b = bpe.WordBpe(P.path("word_bpe_49k.json"))
    ids = b.encode("Hello wonderful WORLD 123 don't")
    assert b.decode(ids) == "hello</w> wonderful</w> world</w> 1</w> 2</w> 3</w> don</w> 't</w>"


def test_bpe_decodes_its_ids_and_refuses_other_files(spark, odd, tmp_path):
    path = P.path("word_bpe_49k.json")
    enc = bpe.encode(odd, path)
    back = {(r["doc_id"], r["decoded"]) for r in bpe.decode(enc, path).collect()}
    assert back == {(r["doc_id"], r["decoded"]) for r in enc.collect()} and (2, "") in back
    with pytest.raises(ValueError):
        bpe.WordBpe(P.path("byte_bpe_50k.json"))


def test_kept_results_stay_while_they_are_used():
    from cutoffs.llm.common import Kept

    kept = Kept(3)
    for k in range(40):
        keys = {"often", k}
        for x in kept.missing(keys):
            assert x != "often" or k == 0
            kept.young[x] = str(x)
        assert all(kept.young[x] == str(x) for x in keys)
        assert len(kept.young) + len(kept.old) <= 10


# Token file --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_token_file_is_the_library(request, table):
    df = request.getfixturevalue(table)
    path = P.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()]
    got = tokenfile.documents(tokenfile.write(df, path, shard_tokens=5000, partitions=3)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in rows)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        at, last = at + r["n_tokens"], r["doc_id"]


def test_token_file_keeps_words_apart_from_what_follows():
    bpe_ = tokenfile.ByteBpe(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    some = ["a", "B", "it", "'s", "' ", "don't", "é", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2003", "\u3000", "“", "漢", "\u094d", "ు", ",", "...", "#", "_", "<", "|", "<|", "1", "½", "\x1c", "\x00", "\u0085", "\ufeff", "😀", "->", "I'll", "s"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", " ", "\n", " a", "a "]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in bpe_.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert bpe_.encode([t.encode() for t in texts]) == want
    bpe_ = tokenfile.ByteBpe(P.path("byte_bpe_50k.json"))
    bpe_.encode([b"One word,\nTwo word. Two word"])
    assert set(bpe_.kept.young) == {b"One", b" word", b",", b"\nTwo", b".", b" Two"}


def test_a_shard_ends_with_the_document_that_fills_it(spark):
    df = spark.createDataFrame([(k, "one two three") for k in range(100)], "doc_id bigint, text string").coalesce(1)
    shards = tokenfile.write(df, P.path("byte_bpe_50k.json"), shard_tokens=20, partitions=1).collect()
    assert len(shards) > 5 and max(r["n_tokens"] - r["sizes"][-1] for r in shards) < 20


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (5000, 3), (30000, 40), (70000, 60000)])
def test_re_pair_round_trip_and_random_access(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype("<u4")
    g = tokenfile.Grammar(tokenfile.pack(ids))
    assert (g.read() == ids).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (g.read(a, b) == ids[a:b]).all()


def most_frequent(seq):
    """How often the most frequent pair occurs, without overlap (brute force)."""
    n = Counter()
    last = {}
    for i, p in enumerate(zip(seq, seq[1:])):
        if last.get(p, -2) < i - 1:
            n[p] += 1
            last[p] = i
    return max(n.values(), default=0)


@pytest.mark.parametrize("kind", ["zipf", "runs", "periods", "text"])
def test_re_pair_stops_when_no_pair_is_frequent(kind):
    rng = np.random.default_rng(8)
    ids = {
        "zipf": rng.zipf(1.2, 40_000) % 200,
        "runs": np.repeat(rng.integers(0, 3, 3000), rng.integers(1, 30, 3000)),
        "periods": np.tile(rng.integers(0, 9, 17), 1500),
        "text": np.concatenate([np.arange(k, k + 7) for k in rng.integers(0, 300, 9000)]),
    }[kind].astype("<u4")
    seq, rules, base = tokenfile.re_pair(ids, least=24)
    assert most_frequent(seq.tolist()) < 24
    open_ = dict(enumerate(rules.tolist(), base))
    for k, pair in open_.items():
        assert max(pair) < k  # a rule refers to earlier ones
    # every rule was made for a pair that was frequent: opened in reverse, it stands for many places
    used = Counter(seq.tolist())
    for k in sorted(open_, reverse=True):
        assert used[k] >= 12
        for x in open_[k]:
            used[x] += used[k]
    assert (tokenfile.Grammar(tokenfile.pack(ids)).read() == ids).all()


def test_rules_stop_where_they_no_longer_pay():
    rng = np.random.default_rng(9)
    ids = (rng.zipf(1.3, 60_000) % 40_000).astype("<u4")
    assert tokenfile.paying(50_000) == 7 and tokenfile.paying(1 << 20) == 5
    sizes = {n: len(tokenfile.pack(ids, n)) for n in (2, 4, 24, 200)}
    assert len(tokenfile.pack(ids)) <= min(sizes.values()) * 1.02
    assert most_frequent(tokenfile.re_pair(ids)[0].tolist()) < tokenfile.paying(int(ids.max()) + 1)


def test_first_rules_are_the_most_frequent_pairs():
    ids = np.array(([1, 2] * 40 + [9]) * 30 + [3, 4, 5] * 50 + [6, 7] * 30, dtype="<u4")
    _, rules, _ = tokenfile.re_pair(ids, least=24)
    assert rules[0].tolist() == [1, 2]


# Chains, language ID, language model ------------------------------------------------------------------------------


def test_chains_are_exact():
    """Forward and posterior sums against all label paths."""
    from itertools import product

    rng = np.random.default_rng(2)
    move, start = rng.random((3, 3)) + 0.1, rng.random(3)
    lengths = np.array([4, 1, 3])
    emit = rng.random((8, 3)) + 0.05
    c = Chains(lengths)
    by_step = np.empty_like(emit)
    by_step[c.place] = emit
    post, moves, scale = c.posteriors(by_step, move, start)
    like = c.log_likelihood(scale)
    at, total = 0, np.zeros((3, 3))
    for k, n in enumerate(lengths):
        e, z, p = emit[at : at + n], 0.0, np.zeros((n, 3))
        pairs = np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = start[path[0]] * e[0, path[0]]
            for i in range(1, n):
                w *= move[path[i - 1], path[i]] * e[i, path[i]]
            z += w
            for i, s in enumerate(path):
                p[i, s] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        assert math.isclose(like[k], math.log(z), rel_tol=1e-9)
        assert np.allclose(post[c.place][at : at + n], p / z)
        total += pairs / z
        at += n
    assert np.allclose(moves, total)


def test_language_id(spark, docs, odd, none):
    learn = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    field = langid.train(learn)
    got = langid.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert got.filter("lang_pred = lang").count() >= 0.9 * got.count()
    by = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, field).collect()}
    assert {(d, 0.0) for d, p, s in by if p == "und"} == {(d, s) for d, p, s in by if d in (2, 3, 4, 5)}
    assert langid.predict(none, field).count() == 0 and langid.train(none) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    kept = langid.keep_known(odd, field)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 6, 7, 8, 9}
    assert kept.filter("doc_id = 8").count() == 2


def plain_label(text, field):
    """Language and score of a text, word by word and state by state (brute force)."""
    m64 = (1 << 64) - 1

    def mix(x):
        for k, c in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = ((x ^ x >> k) * c) & m64
        return x ^ x >> 33

    low = (text or "").lower()
    words = re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low.encode())
    if not words or not any(map(str.isalpha, text)):
        return "und", 0.0
    mask, n = (1 << langid.FEATURE_BITS) - 1, len(field.langs)
    rows = []
    for w in words:
        b = b"^" + w + b"$"
        feats = [mix(int.from_bytes(b[i : i + k], "big") * 8 + k) & mask for k in range(1, 5) for i in range(len(b) - k + 1)]
        feats.append(mix(sum(mix(c + i * 257) for i, c in enumerate(b)) & m64) & mask)
        e = [float(sum(field.weight[f][j] for f in feats)) / math.sqrt(len(feats)) for j in range(n)]
        rows.append([math.exp(max(-60.0, x - max(e))) for x in e])
    move, first = np.exp(field.move), np.exp(field.first)
    fwd, bwd = [np.array(first) * rows[0]], [np.ones(n)]
    for e in rows[1:]:
        fwd.append((fwd[-1] @ move) * e)
        fwd[-1] = fwd[-1] / fwd[-1].sum()
    for e in rows[:0:-1]:
        bwd.append(move @ (np.array(e) * bwd[-1]))
        bwd[-1] = bwd[-1] / bwd[-1].sum()
    post = [f * b / (f * b).sum() for f, b in zip(fwd, bwd[::-1])]
    mean = np.mean(post, axis=0)
    return field.langs[int(mean.argmax())], float(mean.max())


def test_language_prediction_is_brute_force(spark, docs, odd, monkeypatch):
    field = langid.train(docs)
    for df in (docs.orderBy("doc_id").limit(25), odd):
        want = Counter((r["doc_id"], *((x := plain_label(r["text"], field))[:1]), round(x[1], 4)) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.predict(df, field).collect()) == want
    # a text of several stretches is one chain
    texts = [r["text"] for r in docs.orderBy(F.desc("n_chars")).limit(12).collect()] + ["kurz und gut", None, "the cat und der hund " * 20]
    monkeypatch.setattr(langid, "CHAIN_WORDS", 1 << 30)
    whole = langid.label(texts, field)
    for words in (4096, 40, 7, 1):
        monkeypatch.setattr(langid, "CHAIN_WORDS", words)
        parts = langid.label(texts, field)
        assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], rtol=0, atol=1e-9)


def test_moves_between_languages_are_learnt(docs):
    rows = [r for r in docs.orderBy("doc_id").collect() if r["lang"] and r["text"]]
    field = langid.fit([r["text"].lower().encode() for r in rows], [r["lang"] for r in rows])
    off = field.move[~np.eye(len(field.langs), dtype=bool)]
    assert (np.diag(field.move) > off.max()).all() and off.min() > -4  # switches are rare, not ruled out


def test_language_id_follows_a_switch():
    en, de = ["the house and the garden of my friend"] * 30, ["der hund und die katze in dem haus"] * 30
    field = langid.fit([t.encode() for t in en + de], ["en"] * 30 + ["de"] * 30)
    _, number, distinct, _, lengths = langid._chains([b"the house and the garden und die katze in dem haus"])
    scores, _, _ = field.emissions(distinct)
    c = Chains(lengths)
    by_step = np.empty(len(number), dtype=np.int64)
    by_step[c.place] = number
    post, _, _ = c.posteriors(field.potentials(scores)[by_step], np.exp(field.move), np.exp(field.first))
    assert [field.langs[k] for k in post[c.place].argmax(axis=1)] == ["en"] * 5 + ["de"] * 6


SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_language_model_base_is_brute_force(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], SPLIT.findall((r["text"] or "").encode().lower()) + ["end"]) for r in df.select("doc_id", "text").collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for d, ws in rows)
    got = hmm.score(df, passes=1).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_language_model_beats_single_words_and_is_a_distribution(docs, none):
    out = hmm.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]
    assert hmm.score(none).count() == 0


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 50, rng.integers(1, 40)) for _ in range(60)]
    emit = np.full(50, 1 / 50)[:, None] * (0.2 + rng.gamma(1.0, size=(50, hmm.STATES)))
    model, last = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), np.full((hmm.STATES, hmm.STATES), 1 / hmm.STATES), emit / emit.sum(axis=0)), -math.inf
    for _ in range(4):
        now = model.log10(seqs).sum()
        assert now >= last - 1e-6
        s, m, e, like = model.expected(seqs)
        assert math.isclose(like / math.log(10), now, rel_tol=1e-9)
        model, last = hmm.Model((s + 1e-9) / (s + 1e-9).sum(), (m + 1e-9) / (m + 1e-9).sum(axis=1, keepdims=True), (e + 1e-12) / (e + 1e-12).sum(axis=0)), now


def plain_forward(model, seq):
    """log10 of a sequence's probability, one step at a time in exact order (brute force)."""
    at, total = [float(x) for x in model.start], 0.0
    for t, s in enumerate(seq):
        if t:
            at = [sum(at[i] * model.move[i][j] for i in range(len(at))) for j in range(len(at))]
        at = [a * float(model.emit[s][j]) for j, a in enumerate(at)]
        z = sum(at)
        total, at = total + math.log10(z), [a / z for a in at]
    return total


def plain_expected(model, seqs):
    """Expected counts by the sums over all pairs of states at all places (brute force)."""
    n = len(model.start)
    start, move, emit = np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape)
    for seq in seqs:
        fwd, bwd = np.zeros((len(seq), n)), np.ones((len(seq), n))
        for t, s in enumerate(seq):
            fwd[t] = (model.start if t == 0 else fwd[t - 1] @ model.move) * model.emit[s]
        for t in range(len(seq) - 2, -1, -1):
            bwd[t] = model.move @ (model.emit[seq[t + 1]] * bwd[t + 1])
        z = fwd[-1].sum()
        start += fwd[0] * bwd[0] / z
        for t, s in enumerate(seq):
            emit[s] += fwd[t] * bwd[t] / z
            if t:
                move += fwd[t - 1][:, None] * model.move * (model.emit[s] * bwd[t])[None] / z
    return start, move, emit


def test_language_model_score_is_brute_force(spark, monkeypatch):
    """Training and scoring told again without Spark: counts, classes, Baum-Welch passes, forward recursion, shares."""
    rng = np.random.default_rng(31)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    rows = [(d, " ".join(words[k] for k in (rng.zipf(1.5, rng.integers(0, 30)) * 7 % len(words)))) for d in range(60)] + [(900, None), (901, "Neverseen AX ax neverseen")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    toks = {d: [w.decode() for w in SPLIT.findall((t or "").encode().lower())] for d, t in rows}
    count = Counter(w for d, ws in toks.items() if not held(d) for w in ws)
    seen = []
    real = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda coded, lex, *a: seen.append((lex, real(coded, lex, *a))) or seen[-1][1])
    for top in (10_000, 12):
        out = {r["doc_id"]: r["score"] for r in hmm.score(df, top_words=top, passes=2).collect()}
        lex, model = seen[-1]
        # the largest set of most frequent words that fits, by the steps of their counts
        step = {w: math.floor(math.log2(n) * 64) for w, n in count.items()}
        levels = sorted(set(step.values()), reverse=True)
        own = max((w for w in ({w for w in count if step[w] >= v} for v in levels) if len(w) <= top), key=len, default=set())
        assert lex.n_top == len(own) and lex.total == sum(count.values()) + sum(not held(d) for d in toks)
        one = {w: hmm.Words([w.encode()], hmm.SPACED) for ws in toks.values() for w in ws}
        kind = {w: int(hmm.word_class(x)[0]) for w, x in one.items()}
        number = {w: int(np.searchsorted(lex.top, one[w].hash[0])) for w in own}
        code = lambda ws: [number[w] if w in own else lex.n_top + kind[w] for w in ws] + [lex.symbols_n - 1]
        mass, size = Counter(), Counter()
        for w in count:
            if w not in own:
                mass[kind[w]] += count[w]
                size[kind[w]] += 1
        share = lambda w: math.log10((count[w] + 0.5) / (mass[kind[w]] + 0.5 * (size[kind[w]] + 1)))
        for d, ws in toks.items():
            want = plain_forward(model, code(ws)) + sum(share(w) for w in ws if w not in own)
            assert math.isclose(out[d], want, rel_tol=1e-7, abs_tol=1e-7)
        # the last pass over the corpus is one step of Baum-Welch from the model before it
        parts = [code(ws) for d, ws in toks.items() if not held(d)]
        coded = spark.createDataFrame([(bytearray(np.array(code(ws), dtype=lex.kind).tobytes()),) for d, ws in toks.items() if not held(d)], "sym binary")
        prior = (np.concatenate((lex.top_n, lex.class_n, [lex.end_n])) + 0.5) / (np.concatenate((lex.top_n, lex.class_n, [lex.end_n])) + 0.5).sum()
        before, after = real(coded, lex, 0), real(coded, lex, 1)
        want = hmm.Model.from_counts(*plain_expected(before, parts), prior)
        assert np.allclose(want.emit, after.emit) and np.allclose(want.move, after.move) and np.allclose(want.start, after.start)
        with monkeypatch.context() as m:  # long texts are scored in steps
            m.setattr(hmm, "LONG", 7)
            got = model.log10([np.array(code(ws)) for ws in toks.values()])
            assert np.allclose(got, [plain_forward(model, code(ws)) for ws in toks.values()])
        assert np.allclose(after.emit.sum(axis=0), 1) and np.allclose(after.move.sum(axis=1), 1) and math.isclose(after.start.sum(), 1)


def test_texts_are_drawn_by_hash(spark):
    from cutoffs.llm.common import drawn

    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = {r["id"] for r in df.orderBy("h").limit(100).collect()}
    assert {r["id"] for r in drawn(df, 100, "id").collect()} == want
    assert drawn(df, 6000, "id").count() == 5000 and drawn(df.limit(0), 10, "id").count() == 0
    assert drawn(spark.range(500).withColumn("id", F.lit(None).cast("bigint")), 20, "id").count() == 20


# Toxicity ----------------------------------------------------------------------------------------------------------


def plain_kernel(s, t):
    """The kernel by its definition, over all pairs of places."""
    from itertools import combinations

    def phi(x):
        out = Counter()
        for at in combinations(range(len(x)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(x[i] for i in at)] += toxicity.GAP ** (at[-1] - at[0] + 1)
        return out

    a, b = phi(s), phi(t)
    dot = lambda p, q: sum(p[k] * q[k] for k in p)
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_kernel_is_its_definition():
    words = ["idiot", "idxiot", "iidiott", "clown", "disgusting", "the", "disgustingly"]
    got = toxicity.Kernel(["idiot", "disgusting"]).of(words)
    for w, row in zip(words, got):
        for t, x in zip(("idiot", "disgusting"), row):
            k = plain_kernel(w, t)
            assert math.isclose(x, k if k >= toxicity.FLOOR else 0.0, abs_tol=1e-5)


def plain_score(model, text):
    """The score of a text by the definitions of words, sentences, kernel, features and machine (brute force)."""
    sentences, now, run = [[]], [], []

    def spelled(to):
        if len(run) >= 3:
            to.append("".join(x for x, _ in run).lower())
        run.clear()

    spans = list(re.finditer(rb"[^\x20\x09-\x0d]+", text))
    homes = []
    for m in spans:
        w = m.group().lower()
        sentences[-1].append(toxicity.plain(m.group()))
        homes.append(sentences[-1])
        if len(w) == 1 and w.isalnum():
            run.append((w.decode(), homes[-1]))
        else:
            spelled(run[0][1] if run else now)
        if w[-1:] in (b".", b"!", b"?") or text[m.end() : m.end() + 1] == b"\n":
            sentences.append([])
    spelled(run[0][1] if run else now)
    marks, best = model.kernel.landmarks, model.bias
    for words in sentences:
        k = np.zeros(len(marks))
        for w in words:
            if len(w) >= toxicity.ORDER:
                k = np.maximum(k, [x if (x := plain_kernel(w, t)) >= toxicity.FLOOR else 0.0 for t in marks])
        if k.any():
            best = max(best, float(k @ model.lift @ model.weight) + model.bias)
    return 1 / (1 + math.exp(-(model.slope * best + model.offset)))


def test_toxicity_score_is_brute_force(spark):
    rng = np.random.default_rng(16)
    fill = [f"{a}{b}" for a in ("talu", "reka", "moni", "vipe") for b in ("sa", "do", "ne")]
    rows = [(i, " ".join(fill[k] for k in rng.integers(0, 12, 9)) + (". You idiot scum!" if i % 2 else ".")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int"))
    texts = [t.encode() for _, t in rows[:4]] + [b"you ID-IOT\nand i d i o t here. s c u m", b"iddiot idixot! scxum", b"", b" \n ", "été idiöt".encode(), b"a b c d. e f g"]
    got = model.scores(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)


def test_toxicity_learns_and_tolerates_gaps(spark, odd, none):
    rng = np.random.default_rng(6)
    fill = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "ni") for b in ("lu", "sa", "pe") for c in ("ka", "do", "vi")]
    bad = ["idiot", "moron", "pathetic", "scum"]
    rows, labels = [], []
    for i in range(240):
        w = [fill[k] for k in rng.integers(0, len(fill), 30)]
        if i % 3 == 0:
            w[int(rng.integers(30))] = bad[int(rng.integers(4))]
        rows.append((i, ". ".join(" ".join(w[a : a + 6]) for a in range(0, 30, 6))))
        labels.append((i, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels + [(9999, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, lab.filter("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.score(df, model).collect()}
    held = [i for i in range(240) if i % 4 == 2]
    assert np.mean([got[i] == (i % 3 == 0) for i in held]) >= 0.95
    s = model.scores([b"you idxiot there", b"you i d i o t there", b"you path.etic there", b"talu kado redo", b""])
    assert (s[:3] > 0.3).all() and (s[3:] < 0.3).all()
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(df, lab.filter("toxic = 0"))).collect()} == {0.0}


# Pipeline and registry ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe_round_trip"]
    cur = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        nxt = stage(spark, cur, SF)
        assert nxt.columns == docs.columns and nxt.count() <= cur.count()
        cur = nxt
    out = corpus_pipeline.run(spark, SF)
    left = {(r["doc_id"], r["ids_sha256"]) for r in out.collect()}
    path = P.path("word_bpe_49k.json")
    assert left == {(r["doc_id"], r["ids_sha256"]) for r in bpe.digests(cur, path).collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("table", ["odd", "none"])
def test_pipeline_runs_on_odd_and_empty_tables(spark, request, tmp_path, table):
    request.getfixturevalue(table).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and (set(ids) == {1, None, 6, 7, 8, 9} if table == "odd" else not ids)


def test_clashing_columns_do_no_harm(spark, odd):
    names = ["row", "sym", "known", "base", "norm", "rare", "word", "n", "hit", "items", "fp", "node", "size", "k", "band", "c", "e", "held_out", "score", "h", "bucket"]
    wide = odd.select("doc_id", "text", "lang", "source", *[F.lit(7).alias(x) for x in names])
    same = lambda f: Counter(map(str, f(wide).collect())) == Counter(map(str, f(odd).collect()))
    assert same(lambda d: hmm.score(d, passes=1)) and same(simhash.near_duplicates) and same(lambda d: langid.predict(d, langid.train(d)))
    assert same(lambda d: sharding.interleave(d)) and same(lambda d: quality.rules(d, d.select("doc_id").limit(0)))
    assert neardup.keep_one(wide).columns == wide.columns and linededup.clean(wide).columns == wide.columns


def test_repeated_and_null_ids_in_token_files(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "x y"), (None, None), (2, "")]
    path = P.path("byte_bpe_50k.json")
    out = tokenfile.documents(tokenfile.write(spark.createDataFrame(rows, "doc_id bigint, text string"), path, shard_tokens=3, partitions=4)).collect()
    got = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1, 2] and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(6)]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names

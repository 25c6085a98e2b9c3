"""Filter audit, SuperMinHash near-dedup and hard negatives against plain brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutoffs.llm import filteraudit, negatives, superminhash
from cutoffs.llm.common import mixed

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, digest string, n string"
CLEAN = " ".join(f"wort{i}" for i in range(220))
CAPITALS = " ".join(f"Wort{i} EINS" for i in range(150))


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def plain_audit(rows, labels):
    """{(part, order, step): counts} by applying the filters one after the other, once for each order."""
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    failed = []
    for i, t, s in rows:
        t, w = t or "", words(t)
        has = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        failed.append((s or "", {f for f, x in has.items() if x}, i in good, i in toxic))
    out, share = {}, Counter()
    for part in {x[0] for x in failed}:
        mine = [x for x in failed if x[0] == part]
        for order in permutations("ABCDE"):
            gone: set = set()
            for step, f in enumerate(order, 1):
                hit = [k for k, x in enumerate(mine) if f in x[1]]
                now = [k for k in hit if k not in gone]
                again = len(hit) - len(now)
                gone |= set(now)
                out[part, "".join(order), step] = (len(mine) - len(gone), len(now), again, sum(x[1] == {f} for x in mine), sum(mine[k][2] for k in now), sum(mine[k][3] for k in now))
                share[part, f] += len(now)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(seed):
    rng = random.Random(seed)
    pool = [CLEAN, CLEAN + " #", CAPITALS, "kurz", "", None, " \t\n", "GROSS", CLEAN + " ß é", "ja nein " * 150, "ja nein " * 150 + "&"]
    ids = list(range(60)) + [7, 7, None, None]
    rows = [(i, rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in ids]
    rows += [(200 - i, "viele gleiche", rng.choice("ab")) for i in range(40)] + [(3, CLEAN, "a")] * 5 + [(3, CLEAN, "b")] * 3
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def read_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


@pytest.mark.parametrize(("seed", "batches", "files"), [(1, 4, 4), (2, 1, 3), (3, 2, 1)])
def test_audit_is_brute_force_in_any_order_of_arrival(spark, tmp_path, seed, batches, files):
    rows, labels = audit_rows(seed)
    rows += [((1 << 60) + k, "grosse zahlen", "z") for k in (5, 3, 9)]
    at = str(tmp_path / "documents.parquet")
    for k in range(files):  # files come in the order in which they are written
        spark.createDataFrame([(*r, "x", "y") for r in rows[k::files]], DOCS).coalesce(1).write.mode("append").parquet(at)
    got = filteraudit.audit(spark, at, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), batches)
    assert read_audit(got) == plain_audit(rows, labels)


def test_audit_takes_back_what_a_smaller_id_changes(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    for rows in ([(9, CLEAN, "a"), (9, CLEAN, "b")], [(12, CLEAN, "a"), (5, CLEAN, "c")], [(2, CLEAN, None)]):
        spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).coalesce(1).write.mode("append").parquet(at)
    log = filteraudit.changes(spark, at, batches=3).collect()
    assert sum(r["n"] < 0 for r in log) == 3  # two parts of 9, then 5
    sums = Counter()
    for r in log:
        sums[r["doc_id"], r["part"], r["mask"]] += r["n"]
    assert {k: n for k, n in sums.items() if n} == {(9, "a", 16): 1, (9, "b", 16): 1, (12, "a", 16): 1, (5, "c", 16): 1, (2, "", 0): 1}


def test_audit_of_no_rows(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(at)
    assert filteraudit.audit(spark, at, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_audit_state_gets_few_rows_of_a_text_that_all_have(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("gleich").alias("text"), F.lit("s").alias("source"), F.lit("").alias("digest"), F.lit("").alias("n")).coalesce(2).write.parquet(at)
    log = filteraudit.changes(spark, at, batches=1)
    assert {(r["mask"], r["n"]) for r in log.groupBy("mask").agg(F.sum("n").alias("n")).collect()} == {(1, 1), (17, 19_999)}


def plain_signature(s, places):
    """SuperMinHash as published: one element after the other, with its permutation written out."""
    h = np.full(places, np.inf)
    for d in s.tolist():
        p = list(range(places))
        for j in range(places):
            x = int(mixed(np.array([(d + int(superminhash._STEP) * (j + 1)) % 2**64], dtype=np.uint64))[0])
            k = j + (((x & 0xFFFFFFFF) * (places - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], j + (x >> 32) / 2**32)
    return h


def test_signatures_are_their_definition():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, size=n).astype(np.uint64) for n in (0, 1, 2, 7, 60, 300)]
    for s, got in zip(sets, superminhash.signatures(sets, 40), strict=True):
        assert (plain_signature(s, 40) == got).all()


def test_signatures_vary_less_than_independent_ones():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(300):
        a = rng.integers(0, 2**63, size=200).astype(np.uint64)
        b = np.concatenate((a[:180], rng.integers(0, 2**63, size=20).astype(np.uint64)))
        x = superminhash.signatures([a, b])
        same.append((x[0] == x[1]).mean())
    p = 180 / 220
    assert abs(np.mean(same) - p) < 0.01 and np.var(same) < 0.9 * p * (1 - p) / x.shape[1]


def plain_copies(rows):
    """(id, set size, component, kept) for each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = [x.encode().lower().decode() for x in words(t)]
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def found_copies(df):
    return sorted([tuple(r) for r in superminhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_copies_are_brute_force_on_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(1, None), (2, ""), (3, " \t"), (None, "drei kleine worte"), (4, "DREI kleine Worte"), (5, "drei kleine worte"), (None, "nur einmal da"), (6, "nur einmal da."), (7, "eins zwei drei vier fünf"), (7, "eins zwei drei vier fünf"), (8, "İ ist nicht i"), (9, "i̇ ist nicht i"), (None, None)]
    for k in range(60):  # a family of texts at all distances from its middle, and a second one
        w = list(base if k % 3 else base[::-1])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((100 + k, " ".join(w)))
    # sets of 17 and 20 elements: exactly 85 in a hundred, and just under
    rows += [(300, " ".join(base[:24])), (301, " ".join(base[:21])), (302, " ".join([*base[40:60], "a", "b", "c", "d"])), (303, " ".join(base[40:60]))]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], DOCS)
    assert found_copies(df) == plain_copies(rows)


def test_copies_are_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found_copies(df) == plain_copies([(r["doc_id"], r["text"]) for r in df.collect()])


def test_copies_of_no_rows_and_of_a_very_long_text(spark):
    assert found_copies(spark.createDataFrame([], DOCS)) == []
    text = " ".join(f"wort{i}" for i in range(250_000))
    rows = [(1, text), (2, text + " ende"), (3, "kurz")]
    got = found_copies(spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], DOCS))
    assert got == [(1, 249_996, 1, True), (2, 249_997, 1, False), (3, 1, 3, True)]


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, id int"


def plain_negatives(rows):
    good = set()
    for i, v, y in rows:
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, y, v in (r for r in good if r[0] is not None and r[0] % 100 == 0):
        score = sorted(((sum(p * q for p, q in zip(v, w, strict=False)), i, z) for i, z, w in good), key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in score if s[2] == y and s[1] != a][:5]:
            fit = [s for s in score if s[2] != y and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(a, i, k, j, p, s) for k, (s, j, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def found_negatives(df, **k):
    out = negatives.hard_negatives(negatives.vectors(df), F.col("id") % 100 == 0, **k)
    return sorted([tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=str)


@pytest.mark.parametrize("blocks", [(4096, 4096), (2, 37)])
def test_negatives_are_brute_force(spark, blocks):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.2), 1) for _ in range(13)], rng.randrange(3)) for i in range(500)]
    rows += [(500, None, 1), (600, [1.0] * 13, None), (700, [float("nan")] * 13, 1), (800, [float("inf")] * 13, 1), (900, [None] * 13, 1), (None, [0.5] * 13, 1), (None, [0.5] * 13, 2), (1000, [0.2, 0.3], 1), (1100, [], 2), (1200, [0.0] * 13, 0)]
    rows += rows[:3] * 2 + [(100, [0.1] * 13, 2), (100, [0.1] * 13, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = found_negatives(df, anchors=blocks[0], candidates=blocks[1])
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_of_large_numbers_and_of_no_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-4e6, 4e6) for _ in range(9)], i // 10 % 2) for i in range(0, 900, 10)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = found_negatives(df)
    assert got == plain_negatives(rows) and got
    assert found_negatives(df.limit(0)) == []


def test_scores_are_inner_products():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-300, 300, size=(7, 24)), rng.integers(-(1 << 12), 1 << 12, size=(50, 24))
    assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(c, 13)) == a @ c.T).all()

"""Quality rules with an n-gram log-likelihood ratio between trusted and raw text; DataFrame operations only.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the buckets are counted with
add-one smoothing: one over all documents that labels mark as good (trusted target), one over all documents (raw). The
trusted ids are sent to the tasks in blocks by the hash of the id, each block with the documents of that hash only, so
that texts are never shuffled and each is cut into n-grams once; the counts of the blocks are added up. A document's score is the mean over its n-grams of log p_target - log p_raw; it passes if the score is at least
`threshold`. The table of ratios has one entry per bucket, whatever the size of the corpus.

Defined results: a null text has no words; a document without n-grams has score null and fails by the base rules; with
no trusted rows all ratios are null and the base rules alone decide; repeated rows are counted and scored one by one;
an empty table gives an empty result; `documents` columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutoffs.llm.common import SPACE, let
from cutoffs.session import materialize

BUCKETS = 8192
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.1
WINDOW = 8
#: About so many trusted ids are sent to the tasks at once; more ids mean more passes over the documents.
BLOCK_IDS = 500_000


def words(text: Column) -> Column:
    """Words between ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def buckets(word_hashes: Column, n_buckets: int = BUCKETS) -> Column:
    """Bucket numbers (0-based) of all unigrams, then all bigrams, of an array of word hashes."""
    one = F.transform(word_hashes, lambda h: F.pmod(F.xxhash64(h), F.lit(n_buckets)).cast("int"))
    pairs = F.transform(word_hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(word_hashes, i + 1)), F.lit(n_buckets)).cast("int"))
    return F.concat(one, F.slice(pairs, 1, F.greatest(F.size(word_hashes) - 1, F.lit(0))))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows of docs and over those whose id is in trusted (doc_id)."""
    d = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # of the documents' type, so that equal ids have equal hashes
    good = trusted.select(F.col("doc_id").try_cast(d.schema["_doc"].dataType).alias("_id")).filter("_id is not null").distinct()
    blocks = max(1, -(-good.count() // block_ids))

    def counted(k: int) -> DataFrame:
        mine, ids = (x.filter(F.pmod(F.xxhash64(c), F.lit(blocks)) == k) if blocks > 1 else x for x, c in ((d, "_doc"), (good, "_id")))
        ids = F.broadcast(ids.withColumn("_good", F.lit(1)))
        both = mine.join(ids, mine["_doc"] == ids["_id"], "left").select("_text", F.coalesce("_good", F.lit(0)).alias("good"))
        grams = both.select("good", F.explode(let(_hashes(F.col("_text")), lambda h: buckets(h, n_buckets))).alias("bucket"))
        # grouped by both: a bucket is counted per task before anything is shuffled
        return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))

    if blocks == 1:
        return counted(0)
    # written one after the other: the ids of one block are in memory at a time
    parts = reduce(DataFrame.union, [materialize(counted(k)) for k in range(blocks)])
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, n_buckets: int = BUCKETS) -> Column | None:
    """The log ratio of each bucket as one constant array, or None if there is no trusted text."""
    rows = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}  # n_buckets rows at most
    n_raw, n_good = (sum(x[k] for x in rows.values()) for k in (0, 1))
    if not n_good:
        return None
    import math

    per = [math.log((rows.get(b, (0, 0))[1] + 1) / (n_good + n_buckets)) - math.log((rows.get(b, (0, 0))[0] + 1) / (n_raw + n_buckets)) for b in range(n_buckets)]
    # as one text, which is cut and read once when the plan is made; repr keeps all digits
    return F.split(F.lit(",".join(map(repr, per))), ",").cast("array<double>")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that occur at least twice in the text, the first included."""

    def covered(grams: Column) -> Column:
        def twice(s: Column) -> Column:
            again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
            return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).alias("n"), i.alias("last")), lambda a: a["n"])

        some = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(some, let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)).otherwise(F.lit(0).cast("long"))

    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
    return F.when(F.size(hashes) <= window, F.lit(0).cast("long")).otherwise(let(grams, covered))


def _score(hashes: Column, table: Column, n_buckets: int) -> Column:
    n = F.size(hashes)
    total = let(buckets(hashes, n_buckets), lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(table, x)))
    return F.when(n > 0, total / (2 * n - 1))


def rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each row."""
    table = ratios(bucket_counts(docs, trusted, id_col, text_col, n_buckets), n_buckets)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        return let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(h).alias("n_repeat_words"),
                (F.lit(None).cast("double") if table is None else _score(h, table, n_buckets)).alias("score"),
            ),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(
        F.col(id_col).alias("doc_id"),
        let(words(F.col(text_col)), of_words).alias("w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = one.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score")
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True)))

"""Removal of passages that repeat across or inside documents, by winnowing over line hashes; DataFrame operations only.

A document is its \\n-separated lines; lines without a word take no part in matching. A window is the shortest run of
lines from a given line that holds at least `min_words` words. Of each window one line is selected: the smallest by hash,
lines of SHORT words or more before shorter ones, the leftmost of equal ones. A selected line is a fingerprint, kept once
however many neighbouring windows select it. Two places that share a run of min_words words share its first window, so
they select the same line of it: no such run escapes the fingerprints.

Fingerprints that occur once are dropped. Each other match is extended both ways from the selected line: forward over the
windows that selected it, and backward over the shortest runs of min_words words that end at a line and begin with such a
window. Each of these runs is joined by its content with its own first place (smallest document key, then position), and
never with all its places, so that a passage in very many documents costs one row for each. A line is in a repeated run of
min_words words exactly if such a window holds it or such a run ends at it; so every line that stands in a run which any
earlier place has is deleted, whichever place that is. Lines without a word between two deleted lines go with them.

Defined results: a null or wordless text has no windows and stays as it is; rows repeated with id and text are one
document (a document never loses lines to itself at the same position); rows with one id and different texts are
different documents; an empty table gives an empty result; other columns are carried along untouched by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.llm.common import SPACE, let
from cutoffs.session import materialize

#: Words of the shortest run that is deleted.
MIN_WORDS = 50
#: Lines of fewer words are selected only where a window has no other.
SHORT = 8


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


def line_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, pos, lh, words) for each line with a word; doc is the column __ld_doc of docs, lh the hash of the line.

    Repeated rows meet as one in each task before they move.
    """
    words = lambda x: F.size(F.array_remove(F.split(x, SPACE + "+"), ""))
    cut = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("lh"), words(x).alias("words")))
    per = docs.select(F.col("__ld_doc").alias("doc"), F.filter(cut, lambda x: x["words"] > 0).alias("lines")).groupBy("doc").agg(F.first("lines").alias("lines"))
    return per.select("doc", F.explode("lines").alias("x")).select("doc", "x.*")


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line: (doc, fp, new, p0, p1, after, key, b_fp, b0, b_after, b_key).

    p0 to p1: the window from the line on; key: hash of its lines; fp: hash of the line it selects; new: whether the
    window before selects another. b0 to p0: the shortest run that ends at the line; b_key: hash of its lines; b_fp: the
    line that the window from b0 on selects. after and b_after: place of the next line with a word. fp and key are null for a run of under min_words words, b_key also where
    the run is that window.
    """
    doc = Window.partitionBy("doc")
    ran = lines.withColumn("upto", F.sum("words").over(doc.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("words"))
    ran = ran.withColumn("next", F.lead("pos").over(doc.orderBy("pos")))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    rank = F.struct((F.col("words") < SHORT).alias("short"), F.col("lh"), F.col("pos"))
    ran = ran.select(
        "doc",
        "pos",
        "lh",
        "upto",
        "before",
        "next",
        F.last("pos").over(ahead).alias("p1"),
        F.last("next").over(ahead).alias("after"),
        (F.last("upto").over(ahead) - F.col("before") >= min_words).alias("full"),
        F.min(rank).over(ahead).alias("least"),
        F.xxhash64(F.collect_list("lh").over(ahead)).alias("key"),
    )
    back = doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    ran = ran.withColumns(
        {
            "prior": F.lag("least.pos").over(doc.orderBy("before")),
            "b0": F.first("pos").over(back),
            "b1": F.first("p1").over(back),
            "b_fp": F.first("least.lh").over(back),
            "b_full": F.col("upto") - F.first("before").over(back) >= min_words,
            "b_key": F.xxhash64(F.collect_list("lh").over(back)),
        }
    )
    full, b_full = F.col("full"), F.col("b_full") & (F.col("b1") != F.col("pos"))
    return ran.select(
        "doc",
        F.when(full, F.col("least.lh")).alias("fp"),
        (full & ~F.col("prior").eqNullSafe(F.col("least.pos"))).alias("new"),
        F.col("pos").alias("p0"),
        "p1",
        "after",
        F.when(full, F.col("key")).alias("key"),
        "b_fp",
        "b0",
        F.col("next").alias("b_after"),
        F.when(b_full, F.col("b_key")).alias("b_key"),
    )


def fingerprints(found: DataFrame) -> DataFrame:
    """(fp): the selected lines of `windows` that occur more than once."""
    return found.filter("new").groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")


def repeated_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, p0, p1, after): runs of lines that occur before, in an earlier document or earlier in the same one."""
    found = materialize(windows(line_table(docs, text_col), min_words).filter("fp is not null or b_key is not null"))
    # the first row of a run of min_words words is a window, so the lines that a run needs for its fingerprint are there
    run = lambda *names: F.struct(*[F.col(c).alias(a) for c, a in zip(names, ("p0", "p1", "after", "fp", "key"), strict=True)])
    both = F.filter(F.array(run("p0", "p1", "after", "fp", "key"), run("b0", "p0", "b_after", "b_fp", "b_key")), lambda x: x["key"].isNotNull())
    runs = found.select("doc", F.explode(both).alias("x")).select("doc", "x.*").join(fingerprints(found), "fp").select("doc", "p0", "p1", "after", "key")
    runs = materialize(runs)
    first = runs.groupBy("key").agg(F.min(F.struct("doc", "p0")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return runs.join(first, "key").filter(F.struct("doc", "p0") != F.col("first")).select("doc", "p0", "p1", "after")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with later repeated runs deleted from the text; with `report`, also n_lines and n_removed (lines).

    The report's columns take the place of columns of docs with their names; without it all columns of docs stay.
    """
    keyed = docs.withColumn("__ld_doc", _key(id_col, text_col))
    gone = repeated_runs(keyed, text_col, min_words).groupBy("doc").agg(F.collect_set(F.struct("p0", "p1", "after")).alias("__ld_runs")).withColumnRenamed("doc", "__ld_at")
    both = keyed.join(gone, keyed["__ld_doc"] == gone["__ld_at"], "left")
    lines = F.split(F.col(text_col), "\\n", -1)
    spots = F.array_distinct(F.flatten(F.transform("__ld_runs", lambda r: F.sequence(r["p0"], r["p1"]))))
    both = both.withColumn("__ld_gone", spots)
    gap = F.filter("__ld_runs", lambda r: (r["after"] > r["p1"] + 1) & F.array_contains("__ld_gone", r["after"]))
    both = both.withColumn("__ld_gone", F.array_union("__ld_gone", F.flatten(F.transform(gap, lambda r: F.sequence(r["p1"] + 1, r["after"] - 1)))))
    stay = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__ld_gone")), lambda i: x[i]), "\n"))
    text = F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(stay)
    extra = [
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__ld_gone").isNull(), F.lit(0)).otherwise(F.size("__ld_gone")).cast("long").alias("n_removed"),
    ]
    names = [c for c in docs.columns if not report or c not in ("n_lines", "n_removed")]
    return both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *(extra if report else []))

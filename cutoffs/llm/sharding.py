"""Proportional stratified interleaving of rows into shards, with DataFrame operations only.

Within each stratum rows are put in a seeded random order; row r of n gets the fractional rank (r - 1/2) / n. Sorting
all rows by fractional rank interleaves the strata in proportion, and cutting that order into equal runs gives shards
that each hold the mixture of the whole table. Both orders are computed by buckets of bounded size (row_number inside a
bucket plus the rows of all buckets before), so no window spans a stratum or the table.

Defined results: a null stratum is a stratum of its own; a null text has size 1 and checksum 0; repeated rows are
placed one by one; an empty table gives an empty result; only the id, text and stratum columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutoffs.session import materialize

#: Rows that a bucket should hold, and the most bits of a bucket number.
BUCKET_ROWS, MOST_BITS = 512, 14


def _ranked(rows: DataFrame, within: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based rank of each row in `order` over each value of `within`; bucket must be monotone in order."""
    group = [*within, bucket]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    return inner.join(offsets, group).withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stratum, size, text_crc32, shard, slot): every row of docs once.

    The order within a stratum is that of md5("seed:doc_id:checksum:size"), then doc_id. Shard sizes differ by at most
    one row; slots count from 0 without gaps in each shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("s"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rank_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size"))
    base = materialize(base.withColumn("key", rank_key))
    total = base.count()
    bits = min(MOST_BITS, max(0, (total // BUCKET_ROWS).bit_length()))
    head = F.conv(F.substring("key", 1, 4), 16, 10).cast("int")
    rows = base.withColumn("b", F.shiftright(head, 16 - bits))
    rows = _ranked(rows, ["s"], "b", ["key", "doc_id"], "r").drop("b")
    counts = base.groupBy("s").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "s").withColumn("f", (F.col("r") + 0.5) / F.col("n"))
    rows = rows.withColumn("b", F.floor(F.col("f") * (1 << bits)).cast("int")).withColumn("one", F.lit(0))
    rows = _ranked(rows, ["one"], "b", ["f", "s", "key", "doc_id"], "g")
    size = max(1, total)
    shard = F.expr(f"cast(g * {shards} div {size} as int)")
    first = F.expr(f"(cast(g * {shards} div {size} as bigint) * {size} + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id",
        F.when(F.col("s") != "", F.expr("substring(s, 2)")).alias("stratum"),
        "size",
        "text_crc32",
        shard.alias("shard"),
        (F.col("g") - first).cast("long").alias("slot"),
    )

"""Filter interaction audit: what each filter removes alone, after others and by its share, for all orders of five filters.

Filters: A under 200 words; B under half of the words distinct; C over two capitals (A-Z) in a hundred characters; D one of
#$%&*| in the text; E the same text under a smaller id. A to D depend on the text alone. E depends on the whole table, and
a table that comes in parts can tell it only for what has come: so all files are processed as micro-batches of a stream
that ends when no file is left. The state of a text is the smallest id seen with it (and the parts of the rows that have
it). A row that arrives under a larger id fails E at once. One that arrives under a smaller id takes the place in the state,
and the row that was there gets two corrections: minus one under its former failures, plus one with E among them. The log
of such changes (doc_id, part, mask, n) can be summed after any micro-batch; its sums, the counters of a part by mask, are
those of the files read so far. All 120 orders follow from the counters.

A text is known by its SHA-256. A task combines the rows of each Arrow batch before they move: only the rows with the
smallest id of a text in it go to the text's state, the others are sent on as they are, so that a text that a third of all
rows have doesn't meet in one task. States are kept together for about TEXTS texts, by a hash of the digest, and looked
through at once: a call for each text costs ten times what its change does. They lie in the state store that the session
names (spark.sql.streaming.stateStore.providerClass), about 70 bytes a text in executors' memory by default, on their disks
with RocksDB, which suits tables whose texts don't fit; either has its changes in the checkpoint. The log is a file sink,
so that each change is in it once, whatever fails.

Defined results: a null text is empty, a null source is the part ''; an empty text has no words and fails A (and E under
an id that isn't the smallest). A row without an id never fails E and makes no other row fail. Repeated rows (same id, same
text) are all counted, neither is a smaller id of the other. Labels of an id: 1 if any of its label rows is 1; ids
without labels, and rows without an id, are neither good nor toxic. An empty table has no parts and gives no rows. Only the
three named columns of the documents are read, so that others can't clash.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import permutations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutoffs.llm.common import SPACE, lean, let
from cutoffs.session import materialize, shared_dir

FILTERS = "ABCDE"
#: The bit of filter E in a mask of failures; filter number i has the bit 1 << i.
SEEN = 16
#: Texts whose states are kept together, about.
TEXTS = 1000
#: Rows on their way to the states. An id that isn't known is 0: a column with nulls would become one of doubles in pandas.
ROW = "bucket bigint, digest binary, doc_id bigint, known boolean, part string, mask int, n bigint"
#: A state: the rows (digest, doc_id, part, mask, n) of each text's smallest id, as an Arrow stream.
STATE = "rows binary"
COLUMNS = ["digest", "doc_id", "part", "mask", "n"]


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text (not null) fails."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")

    def mask(w: Column) -> Column:
        n, chars = F.size(w), F.length(text)
        capitals = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        fails = [n < 200, 100 * F.size(F.array_distinct(w)) < 50 * n, 100 * capitals > 2 * chars, text.rlike("[#$%&*|]")]
        return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))

    return let(words, mask)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, digest, doc_id, part, mask) as rows with n: those with a text's smallest id in the batch, and the rest.

    The rest goes to a bucket of the task, a negative one, with E failed; rows without an id go there as they are.
    """
    aside = -1 - TaskContext.get().partitionId()
    for batch in batches:
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(2).fill_null(0).to_numpy()
        bucket = batch.column(0).to_numpy()
        code, texts = pd.factorize(batch.column(1).to_numpy(zero_copy_only=False))
        mine = known & (ids == _least(code[known], ids[known], len(texts))[code])
        rows = pd.DataFrame({"bucket": np.where(mine, bucket, aside), "code": np.where(mine, code, -1), "doc_id": ids, "known": known, "part": batch.column(3).to_numpy(zero_copy_only=False), "mask": batch.column(4).to_numpy() | np.where(known & ~mine, SEEN, 0)})
        sums = rows.groupby(["bucket", "code", "doc_id", "known", "part", "mask"], sort=False).size().reset_index(name="n")
        digest = np.append(texts, b"")[sums["code"].to_numpy()]  # the place of code -1 is the last
        cols = [pa.array(sums["bucket"].to_numpy(), pa.int64()), pa.array(digest, pa.binary()), pa.array(sums["doc_id"].to_numpy(), pa.int64()), pa.array(sums["known"].to_numpy()), pa.array(sums["part"], pa.string()), pa.array(sums["mask"].to_numpy(), pa.int32()), pa.array(sums["n"].to_numpy(), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["bucket", "digest", "doc_id", "known", "part", "mask", "n"])


def _least(code: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the ids of each of n codes."""
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, code, ids)
    return out


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes that new rows bring to the texts of a bucket."""
    if key[0] < 0:
        yield from frames
        return
    new = pd.concat(list(frames), ignore_index=True)
    had = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new[COLUMNS].iloc[:0]
    old = len(had)
    rows = pd.concat([had, new[COLUMNS]], ignore_index=True) if old else new[COLUMNS]
    code, texts = pd.factorize(rows["digest"].to_numpy())
    ids, mask = rows["doc_id"].to_numpy(), rows["mask"].to_numpy()
    holds = ids == _least(code, ids, len(texts))[code]
    held = rows[holds].groupby(["digest", "doc_id", "part", "mask"], sort=False, as_index=False)["n"].sum() if len(texts) < holds.sum() else rows[holds]
    sink = io.BytesIO()
    table = pa.Table.from_pandas(held[COLUMNS], preserve_index=False).replace_schema_metadata()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    state.update((sink.getvalue(),))
    yield new.assign(mask=np.where(holds[old:], mask[old:], mask[old:] | SEEN).astype(np.int32))
    lost = had[~holds[:old]].assign(bucket=key[0], known=True)
    if len(lost):
        yield lost.assign(n=-lost["n"])[new.columns]
        yield lost.assign(mask=(lost["mask"] | SEEN).astype(np.int32))[new.columns]


def changes(spark: SparkSession, path: str, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The log (doc_id, part, mask, n) of all Parquet files at path (a folder or a file), read in about `batches` micro-batches.

    A query that was stopped goes on from its checkpoint only within one call; the sums of the log don't depend on the number
    of micro-batches, nor on the order of the files.
    """
    whole = spark.read.parquet(path)
    files = whole.inputFiles()
    reader = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", max(1, ceil(len(files) / batches)))
    if len(files) == 1 and files[0].rstrip("/").rpartition("/")[2] == path.rstrip("/").rpartition("/")[2]:
        folder, _, name = path.rstrip("/").rpartition("/")  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", name), folder
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    buckets = max(1, -(-whole.count() // TEXTS))
    rows = reader.parquet(path).select(F.pmod(F.xxhash64(digest), F.lit(buckets)).alias("bucket"), digest.alias("digest"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"))
    log = rows.mapInArrow(lean(_combined), ROW).groupBy("bucket").applyInPandasWithState(_changes, ROW, STATE, "append", GroupStateTimeout.NoTimeout)
    at = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    run = log.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "part", "mask", "n").writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    run.option("path", f"{at}/log").option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return spark.read.schema("doc_id bigint, part string, mask int, n bigint").parquet(f"{at}/log")


def counters(log: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of a part fail just the filters of a mask. labels: doc_id, quality, toxic."""
    of = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    rows = log.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")
    both = rows.join(of.filter("good or toxic"), "doc_id", "left")
    no = F.lit(False)
    return both.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, from the part's counters."""
    masks = range(1 << len(FILTERS))
    held = lambda c, m: F.sum(F.when((F.col("mask") == m) & c, F.col("n")).otherwise(0))
    per = counts.groupBy("part").agg(*[F.array(*[held(c, m) for m in masks]).alias(name) for name, c in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    orders = [("".join(FILTERS[i] for i in p), k + 1, 1 << p[k], sum(1 << i for i in p[:k])) for p in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    step = "array<struct<filter_order: string, step: int, own: int, past: int>>"
    rows = per.withColumn("o", F.explode(F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"own":{f},"past":{p}}}' for o, k, f, p in orders) + "]"), step))).select("part", "n", "good", "toxic", "o.*")

    def total(values: str, where) -> Column:
        """The sum over the masks that where (a function of the mask) holds for."""
        pairs = F.arrays_zip(F.col(values).alias("v"), F.array(*[F.lit(m) for m in masks]).alias("m"))
        return F.aggregate(F.filter(pairs, lambda x: where(x["m"])), F.lit(0).cast("long"), lambda s, x: s + x["v"])

    own, past = F.col("own"), F.col("past")
    fails, before = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(past) != 0)
    # of the orders of the filters that a row fails each begins as often with one as with another
    share = [120 // max(1, m.bit_count()) for m in masks]
    shapley = F.aggregate(F.filter(F.arrays_zip(F.col("n").alias("v"), F.array(*[F.lit(m) for m in masks]).alias("m"), F.array(*[F.lit(s) for s in share]).alias("s")), lambda x: fails(x["m"])), F.lit(0).cast("long"), lambda s, x: s + x["v"] * x["s"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(past)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & ~before(m)).alias("removed"),
        total("n", lambda m: fails(m) & before(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~before(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~before(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The interactions of the five filters over all Parquet files at path."""
    return interactions(materialize(counters(changes(spark, path, batches), labels)))

"""Sinks: partitioned tables, nested documents, manifests, line files, product index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns; a new run replaces its own partitions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def documents(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, document): one nested JSON per key; each table becomes an array of its rows, in order of all columns."""
    out = None
    for name, df in tables.items():
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        out = rows if out is None else out.join(rows, key, "full_outer")
    return out.select(key, F.to_json(F.struct(key, *tables)).alias("document"))


def write_documents(docs: DataFrame, path: str, by: str) -> None:
    docs.select(by, F.col("document").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


#: Bytes of a file that is read as one value, at most; of a piece of a larger one.
WHOLE, PIECE = 1 << 27, 1 << 14
#: Files that Spark's line reader would unpack.
PACKED = "[.](gz|bz2|deflate|lz4|snappy|zst)$"
_MARK = b"\xef\xbb\xbf"


def manifest(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """(path, bytes, sha256) of files, hashed on the executors.

    Files of up to `whole` bytes are read as one value each, which Spark bounds by 2 GB, and so are packed ones. Others are read
    in splits by many tasks, as lines of bytes, which are cut to pieces; as a hash goes from the first byte to the last, one task
    for each file then takes its pieces in order and holds few at once. Only a line has to fit into memory. Spark lists no empty files.
    """
    read = lambda kind: spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    f = read("binaryFile").load(path)
    # both filters are applied before a file's content is read
    packed = F.col("_metadata.file_path").rlike(PACKED)
    one = lambda x: x.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = one(f.filter(F.col("length") <= whole)).union(one(f.filter(packed & (F.col("length") > whole))))
    rest = f.filter(~packed & (F.col("length") > whole)).select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("file"))
    if rest.isEmpty():
        return out
    at = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "bytes"), ("file_block_start", "start"))]
    lines = read("text").option("lineSep", "\n").load(path).filter(~packed & (F.col("_metadata.file_size") > whole))
    pieces = lines.select(*at, F.col("value").cast("binary").alias("line")).mapInArrow(_pieces, "file string, bytes bigint, start bigint, n bigint, piece binary")
    hashed = pieces.repartition("file").sortWithinPartitions("file", "start", "n").mapInArrow(_hashes, "file string, sha256 string")
    return out.union(rest.join(hashed, "file").select("path", "bytes", "sha256"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, bytes, start of the split, line), in order, as numbered pieces in which a newline follows each line."""
    split, n = None, 0
    for batch in batches:
        for a, b, key in _runs(list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))):
            if key != split:
                split, n = key, 0
            data = b"\n".join([*batch.column("line").slice(a, b - a).to_pylist(), b""])
            cut = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
            size = batch.column("bytes")[a].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(cut)), pa.array([size] * len(cut), pa.int64()), pa.array([key[1]] * len(cut), pa.int64()), pa.array(range(n, n + len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["file", "bytes", "start", "n", "piece"])
            n += len(cut)


def _runs(keys: list) -> Iterator[tuple]:
    """(from, to, key) of each run of equal keys."""
    a = 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield a, b, keys[a]
            a = b


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, sha256) of pieces in order. The reader drops a byte order mark and tells no newline at the end: the length does."""
    name, size, got, held = None, 0, 0, b""
    plain = marked = hashlib.sha256()

    def done() -> pa.RecordBatch:
        # all but the last byte, a newline, is hashed by now
        h = {got: plain, got - 1: plain, got + 3: marked, got + 2: marked}.get(size)
        if h is None:
            raise ValueError(f"{name}: read {got} of {size} bytes")
        if size in (got, got + 3):
            h.update(held)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([h.hexdigest()])], names=["file", "sha256"])

    for batch in batches:
        for file, total, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "piece")), strict=True):
            if file != name:
                if name is not None:
                    yield done()
                name, size, got, held = file, total, 0, b""
                plain, marked = hashlib.sha256(), hashlib.sha256(_MARK)
            got += len(piece)
            for h in (plain, marked):
                h.update(held)
                h.update(memoryview(piece)[:-1])
            held = piece[-1:]
    if name is not None:
        yield done()


def write_lines(df: DataFrame, path: str, layer: str) -> None:
    """Text lines by layer (a column of df beside `line`)."""
    df.select(layer, F.col("line").alias("value")).write.mode("overwrite").partitionBy(layer).text(path)


def product_index(products: DataFrame) -> DataFrame:
    """(listed_at, title, url, file, sha256) of fetched products with their content."""
    return products.select("listed_at", "title", "url", F.concat(F.sha2("url", 256), F.lit(".pdf")).alias("file"), F.sha2("content", 256).alias("sha256"))

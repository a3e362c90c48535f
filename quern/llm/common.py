"""Shared helpers: scratch tables in the shared folder, chunks of whole texts, joins that stay even under hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A chunk of documents that is worked on at once holds about this much text.
CHUNK_BYTES = 4 << 20
#: Short rows (keys, counts) in a file of a scratch table whose size is known.
FILE_ROWS = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. There is no other, as a machine's own folders are unseen by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


class Scratch:
    """Intermediate tables of one job, as Parquet in the shared folder. They outlive lost executors, and cut the lineage.

    A result that is computed lazily still reads them, so they are dropped by the caller's ``clear()``, never behind its back.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
        """``rows``: about how many short rows there are at most; few don't go into many files, each of which costs the file system's calls."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        df.write.mode("errorifexists").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name


def hot_keys(groups: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """The keys that hold a thousandth of all rows or more: there are at most 1000, so they may be broadcast."""
    return groups.where(F.col(count) >= F.lit(max(2.0, rows / 1000.0)))


def even_join(left: DataFrame, groups: DataFrame, key: str, count: str, rows: int, unique: Column) -> DataFrame:
    """Left join of ``left`` to ``groups`` (one row a key), even if one key holds most rows of ``left``.

    Rows with a hot key meet it in a broadcast of at most 1000 rows; for the shuffle join they get a key of their own
    (``unique``), so that they are spread like all others.
    """
    hot = hot_keys(groups, key, count, rows)
    names = [c for c in groups.columns if c != key]
    kind = groups.schema[key].dataType
    hot = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    x = left.join(hot, key, "left").withColumn("_key", F.when(F.col("_hot"), unique.cast(kind)).otherwise(F.col(key)))
    # By sort-merge at every size, so that plans and their shuffles grow evenly with the input.
    x = x.join(groups.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_cold_{c}") for c in names]).hint("merge"), "_key", "left")
    return x.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in names])


def chunks_of(batches: Iterator[pa.RecordBatch], id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """Lists of ids and of whole texts with about ``limit`` characters each; a longer text is alone. Null texts stay None."""
    ids: list = []
    texts: list = []
    size = 0
    for b in batches:
        for k, t in zip(b.column(id_col).to_pylist(), b.column(text_col).to_pylist(), strict=True):
            n = len(t) if t else 0
            if ids and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(k)
            texts.append(t)
            size += n
    if ids:
        yield ids, texts


CHUNK_SCHEMA = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("rows", T.BinaryType()), T.StructField("null_ids", T.BinaryType()), T.StructField("lens", T.BinaryType()), T.StructField("blob", T.BinaryType())])


def chunk_store(docs: DataFrame, limit: int = CHUNK_BYTES, row: str | None = None) -> DataFrame:
    """Documents, packed into rows of about ``limit`` bytes of compressed whole texts (null: empty). ``row``: a column of longs that comes along."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        z, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        for k, (keys, texts) in enumerate(chunks_of(batches, "keys", limit=limit)):
            ids, rows = [x["doc_id"] for x in keys], [x["row"] for x in keys]
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            lens = np.array([len(x) for x in raw], "<i8")
            row = {"chunk_id": [(part << 32) + k], "n_docs": [len(ids)], "n_bytes": [int(lens.sum())], "ids": [np.array([x or 0 for x in ids], "<i8").tobytes()], "rows": [np.array([x or 0 for x in rows], "<i8").tobytes()], "null_ids": [np.array([x is None for x in ids], "u1").tobytes()], "lens": [lens.tobytes()], "blob": [z.compress(b"".join(raw))]}
            yield pa.RecordBatch.from_pydict(row, schema=arrow(CHUNK_SCHEMA))

    keys = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col(row or "doc_id").cast("long").alias("row"))
    return docs.select(keys.alias("keys"), whole_text().alias("text")).mapInArrow(lean_batches(pack), CHUNK_SCHEMA)


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Chunk:
    """One row of a chunk store: ``buf`` holds the texts end to end, document i at off[i] : off[i + 1]."""

    def __init__(self, ids: bytes, rows: bytes, null_ids: bytes, lens: bytes, blob: bytes):
        import zstandard

        self.rows = np.frombuffer(rows, "<i8")
        self.ids, self.null = np.frombuffer(ids, "<i8"), np.frombuffer(null_ids, "u1")
        self.lens = np.frombuffer(lens, "<i8")
        self.off = np.concatenate([[0], np.cumsum(self.lens)])
        self.raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(self.off[-1])))
        self.buf = np.frombuffer(self.raw, "u1")

    def doc_ids(self) -> list:
        return [None if n else int(x) for x, n in zip(self.ids, self.null, strict=True)]


def release() -> None:
    """Give memory that is free inside this process back to the system: workers are kept for tasks of later stages, which share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean_batches(run: Callable) -> Callable:
    """A function of an iterator of batches that ends with ``release()``."""

    def task(batches):
        yield from run(batches)
        release()

    return task


def lean_frame(run: Callable) -> Callable:
    """A function of one group that ends with ``release()``: for groups that are large and few."""

    def task(f):
        out = run(f)
        release()
        return out

    return task


def lean_frames(run: Callable) -> Callable:
    """As ``lean_frame``, for two groups side by side."""

    def task(f, g):
        out = run(f, g)
        release()
        return out

    return task


def parallelism(spark: SparkSession) -> int:
    return max(2, SparkContext.getOrCreate().defaultParallelism) if spark else 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

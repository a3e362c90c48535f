"""The running catalog: files of members dropped into a folder, last copy wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.catalog import last_copy_wins


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The catalog after the last whole batch."""
    v = _versions(spark, root)
    return spark.read.parquet(f"{root}/v={v[-1]}") if v else None


def follow(spark: SparkSession, source: str, schema, root: str, checkpoint: str, most_files: int = 100) -> StreamingQuery:
    """Merge arriving members (name, ordinal, ...) into the catalog at ``root``, one version a batch; a repeated batch writes its version again."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = [v for v in _versions(spark, root) if v < batch_id]
        x = batch
        if before:
            x = spark.read.parquet(f"{root}/v={before[-1]}").unionByName(x)
        last_copy_wins(x).write.mode("overwrite").parquet(f"{root}/v={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


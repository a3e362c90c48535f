"""Exact dedup with a persistent digest index (operator 4), DataFrame functions only.

The index is a Parquet table in the shared folder, bucketed and sorted by SHA-256 digest. A batch is reduced to one row a
digest before anything is shuffled far, anti-joined to the index by sort-merge, and what is new is appended. The index side is
not shuffled; each batch appends its own sorted file to a bucket, so Spark sorts a bucket's files once more as it reads them. Which
row stays is told by a join that stays even when one text, new or known, makes up a third of the rows.

The number of buckets is fixed when the index is made, and kept with it.

Defined results: null counts as empty; of equal texts the row with the largest doc_id stays (of rows with equal doc_id
and text, all are told the same); a text that is in the index from an earlier batch keeps no row of this one, and its
keep_id is the one of that batch; texts of any length are one digest; an empty table gives no rows; extra columns are kept
apart from ours by reading doc_id and text alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, even_join, shared_dir, whole_text

COLUMNS = "digest string, keep_id long, group_size long, batch string"


class ExactIndex:
    """Digest index at ``path``. Opening an existing one takes up where it ended, in any session; ``buckets`` counts only for a new one."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex[:12]}"
        self.buckets = self._kept_buckets(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = "quern_index_" + uuid.uuid4().hex[:12]
        spark.sql(f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _kept_buckets(self, buckets: int) -> int:
        """The number that an empty file in the index's folder names; readers pass over names with an underscore."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        kept = [int(n.removeprefix("_buckets-")) for n in names if n.startswith("_buckets-")]
        if kept:
            return kept[0]
        fs.create(path(f"{self.path}/_buckets-{buckets}")).close()
        return buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the batch's new texts; returns doc_id, text_sha256, keep_id, group_size, kept for each row of the batch.

        group_size counts the batch's rows with that text; keep_id is the id that the index has for it. Adding a batch
        again (a retry) changes nothing and returns the same. The result doesn't read the index, only tables of its own.
        """
        scratch = Scratch(self.spark, "groups")
        digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(whole_text(text_col), 256).alias("digest"))
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        # A table of its own: else the anti-join would be moved below the aggregate and meet every copy of a hot text.
        groups = scratch.save(groups, "groups")
        known = self.rows().select("digest")
        fresh = groups.join(known.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        fresh.select("digest", "keep_id", "group_size", "batch").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        # Every text of the batch is in the index now, from this batch or an earlier one.
        held = self.rows().select("digest", "keep_id", (F.col("batch") == batch).alias("mine"))
        told = scratch.save(groups.select("digest", "group_size").join(held.hint("merge"), "digest"), "told")
        n = told.agg(F.sum("group_size")).first()[0] or 0
        out = even_join(digests, told, "digest", "group_size", n, F.concat(F.lit("~"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("~"), F.monotonically_increasing_id().cast("string")))
        return out.select("doc_id", F.col("digest").alias("text_sha256"), "keep_id", "group_size", (F.col("mine") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, index: ExactIndex, batch: str = "0") -> DataFrame:
    return index.add(docs, batch)

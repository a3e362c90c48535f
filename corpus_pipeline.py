"""A corpus pipeline: documents through language ID, line dedup, near-dup removal, substring dedup and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and reads it again as the
next stage's docs. A stage drops the intermediate tables of the pipeline's stage before it, whose result has been written by then;
tables of other jobs are let alone.

In every stage null text counts as empty, texts of any length are read whole, repeated rows are rows of their own, an empty
table gives an empty one, a null doc_id stays null, and other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, fresh
from quern.llm.jaccard import jaccard_join
from quern.llm.langid import keep_identified, train
from quern.llm.lines import dedup_lines
from quern.llm.packing import pack_documents
from quern.llm.queries import TOKENIZER
from quern.llm.suffix import suffix_dedup


_before: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Tables of a stage; those of the stage before go."""
    while _before:
        _before.pop().clear()
    _before.append(Scratch(spark, name))
    return _before[-1]


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str, Scratch]:
    """The documents with a number for each row, as doc_id may repeat, and that column's name."""
    scratch, row = _scratch(spark, name), fresh(docs, "_row")
    return scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row, scratch


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs
    return docs.select(*like.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those with null or empty text or without a letter. The model itself rejects none."""
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines with 8 words go, and with them documents of which nothing else is left; a document without such runs stays, empty ones too."""
    x = dedup_lines(docs, _scratch(spark, "lines")).where((F.col(fresh(docs, "_n_removed")) == 0) | F.col("text").rlike(r"\S"))
    return _with_length(x, docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links connect stays, by the order of the rows as read; texts without words are groups of their own."""
    rows, row, scratch = _numbered(spark, docs, "near")
    found = jaccard_join(rows.select(F.col(row).alias("doc_id"), "text"), scratch)
    stay = found.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(row))
    return rows.join(stay.hint("merge"), row, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated 100-byte strings go, by doc_id, and with them documents of which nothing else is left; a character that a cut parts goes as well."""
    rows, row, scratch = _numbered(spark, docs, "suffix")
    cut = suffix_dedup(rows.select("doc_id", "text", row), scratch, row=row, with_text=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(F.col("row").alias(row), "text")
    return _with_length(rows.drop("text").join(cut.hint("merge"), row), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row a piece; an empty text is the end mark alone."""
    x = pack_documents(docs, TOKENIZER, _scratch(spark, "pack"))
    return x.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dup", near_dup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Language ID, the cut of cut bytes and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared folder and read again."""
    between = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

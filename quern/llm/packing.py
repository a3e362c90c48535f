"""Best-fit packing by sums of squares (operator 1).

Documents become token sequences (ids, then an end id); one longer than a sequence is cut into full pieces, of which only
the first may be shorter. A piece goes to the open bin for which the sum over residual gaps g of N(g)^2 becomes smallest, N(g)
being the number of open bins with that gap (ties: the fullest bin); a new bin is opened only where no open one has
room. The pieces of a group come longest first, so short ones fill what is left.

Full pieces are sequences of their own. The others are dealt at random, in groups of about ``GROUP_PIECES``, to tasks:
a group is large enough that its unfilled bins hardly count, and its size doesn't grow with the input.

Defined results: null or empty text is one piece with the end id alone; equal lengths are taken by (doc_id, piece);
repeated rows are packed as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bpe import codec
from quern.llm.common import Scratch, arrow, lean_batches

SEQUENCE = 1024
END_ID = 2
#: Pieces that one task packs, about.
GROUP_PIECES = 16_384


class SumOfSquares:
    """Online packer: ``place`` gives the bin and the place in it of an item of ``size``."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # N(g); N(0) and N(capacity) do not count
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        c, n = self.capacity, self.count
        if not 0 < size <= c:
            raise ValueError(f"an item of {size} in bins of {c}")
        gap = n[size:c]  # open bins into which it fits
        # Change of the sum of squares: N(g) loses one, N(g - size) gains one; a gap of 0 leaves the sum.
        change = 2 * (n[: c - size] - gap) + 2
        if len(change):
            change[0] = 1 - 2 * gap[0]
            change = np.where(gap > 0, change, np.iinfo(np.int64).max)
            k = int(change.argmin())
            if gap[k] > 0:
                b = self.open[size + k].pop()
                n[size + k] -= 1
                if k:
                    self.open[k].append(b)
                    n[k] += 1
                return b, c - (size + k)
        b, self.bins = self.bins, self.bins + 1
        if size < c:
            self.open[c - size].append(b)
            n[c - size] += 1
        return b, 0


def pack_sizes(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given."""
    s = SumOfSquares(capacity)
    out = np.array([s.place(int(x)) for x in sizes], np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def cut(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, behind a first one with the rest."""
    first = n % capacity
    cuts = [(0, first)] if first else []
    return cuts + [(a, capacity) for a in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(tokenizer, by_library=True), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = c.packed(t) + end
                for i, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * a : 4 * (a + n)]
                    rows.append((k, i, a, n, zlib.crc32(part), part if with_ids else None))
            yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in PIECES.names}, schema=arrow(PIECES))

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(lean_batches(run), PIECES)
    return out if with_ids else out.drop("ids")


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    # pandas has no null among integers, so a null id travels as 0 and a mark.
    marked = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    pieces = scratch.save(marked, "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    every = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "doc_id", "piece", "_row"], ascending=[False, True, True, True], kind="stable")
        b, offset = pack_sizes(x["length"].to_numpy(), capacity)
        return x.assign(sequence_id=(int(x["_group"].iloc[0]) << 32) + b, offset=offset)[every.names]

    # A group is (row number mod groups): as even as can be, and no length or document decides where a piece goes.
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    out = full.select(every.names).unionByName(dealt.groupBy("_group").applyInPandas(run, every))
    return out.withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id"))).drop("_row", "_null")


def pack_documents(docs: DataFrame, tokenizer: str, scratch: Scratch, capacity: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack(pieces_of(docs, tokenizer, capacity, end_id, with_ids), scratch, capacity)

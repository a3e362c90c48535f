"""Chat formatting at token level (operator 7).

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``: role line, text and line end are encoded separately and joined
with the reserved ids, which no text can produce. The loss mask is the prefix sum of +1 at the start and -1 at the end
of an assistant's text. Control strings inside texts are escaped: ``<|`` gets a backslash before the bar, and so does
every run of backslashes between ``<`` and ``|``, which makes it reversible.

Encoding needs no order and runs before the shuffle; then turns are dealt by conversation, sorted in the shuffle, and
streamed: a conversation of any length is never held as a whole, its prefix sums and digests are carried along.

Defined results: null text or role counts as empty; a null conv_id is a conversation of its own; turns with equal numbers
go by role, then by a digest of their ids; repeated rows are repeated turns; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bpe import Codec, codec
from quern.llm.common import arrow

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def escape_role(s: str) -> str:
    """Also without line ends, as the first line end of a turn ends its role."""
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def reserved(c: Codec) -> tuple[int, int]:
    """Ids of START and END: the first two behind the vocabulary."""
    n = len(c.offsets) - 1
    return n, n + 1


def format_turn(c: Codec, role: str, text: str) -> tuple[bytes, bytes]:
    """(ids, mask) of a turn; the mask has a byte for each id."""
    start, end = reserved(c)
    parts = [np.array([start], "<u4"), c.encode(escape_role(role) + "\n"), c.encode(escape(text)), np.array([end], "<u4"), c.encode("\n")]
    at = np.cumsum([0, *map(len, parts)])
    step = np.zeros(at[-1] + 1, np.int64)
    if role == "assistant":
        step[at[2]] += 1
        step[at[3]] -= 1
    return np.concatenate(parts).astype("<u4").tobytes(), np.cumsum(step)[:-1].astype("u1").tobytes()


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("mask", T.BinaryType())])
FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn_no", T.LongType()), T.StructField("token_start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("mask", T.BinaryType())])


def format_conversations(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row a turn, sorted within a conversation: conv_id, turn_no (from 0), token_start (ids of the conversation before it), ids, mask."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            made = [format_turn(c, r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in made], pa.binary()), pa.array([m for _, m in made], pa.binary()), b.column(2)], schema=arrow(with_role))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn_no, tokens, begun = None, 0, 0, False
        for b in batches:
            numbers, starts = [], []
            for k, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now or not begun:
                    now, turn_no, tokens, begun = k, 0, 0, True
                numbers.append(turn_no)
                starts.append(tokens)
                turn_no, tokens = turn_no + 1, tokens + len(n) // 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), b.column(2), b.column(3)], schema=arrow(FORMATTED))

    with_role = T.StructType([*TURNS.fields, T.StructField("role", T.StringType())])
    turns = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").mapInArrow(encode, with_role)
    turns = turns.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("_rest", F.sha2("ids", 256))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "_rest").select(*TURNS.names).mapInArrow(number, FORMATTED)


DIGESTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def read_back(c: Codec, ids: np.ndarray) -> tuple[str, str, int]:
    """(role, text, characters of the formatted turn) from its ids alone."""
    start, end = reserved(c)
    stop = int(np.nonzero(ids == end)[0][0])
    if ids[0] != start or (ids[1:stop] >= start).any() or (ids[stop + 1 :] >= start).any():
        raise ValueError("not a formatted turn")
    body, tail = c.decode(ids[1:stop]), c.decode(ids[stop + 1 :])
    role, _, text = body.partition("\n")
    return unescape_role(role), unescape(text), len(START) + len(body) + len(END) + len(tail)


def digest_formatted(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, read back from formatted turns as they stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        now: list | None = None
        done: list[list] = []

        def flush() -> pa.RecordBatch:
            rows = [[k, n, a.hexdigest(), lc, b.hexdigest(), fc] for k, n, a, lc, b, fc in done]
            done.clear()
            return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(DIGESTS.names)}, schema=arrow(DIGESTS))

        for b in batches:
            for k, no, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if no == 0:
                    if now:
                        done.append(now)
                    now = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                x = np.frombuffer(ids, "<u4")
                role, text, chars = read_back(c, x)
                loss = unescape(c.decode(x[np.frombuffer(mask, "u1") == 1]))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(loss)
                now[4].update(loss.encode("utf-8", "surrogatepass"))
                now[5] += chars
            if done:
                yield flush()
        if now:
            done.append(now)
            yield flush()

    return formatted.mapInArrow(run, DIGESTS)

"""Language identification with string kernels (operator 10).

The kernel of two texts is the number of character n-grams (n = 1 .. 3 together: a blended spectrum) that occur in both,
counted once each, over the root of the product of their own numbers. Landmarks from the training texts give Nystroem
features K(x, L) K(L, L)^(-1/2), on which one-versus-rest ridge regression is solved; texts are scored in batches, as
products of a presence matrix with the landmarks' and of the result with the weights.

N-grams are hashed to ``SLOTS`` places, so any script will do. Lower case is taken, and anything but letters (Unicode's
categories L: numerals such as a half or Roman ones are none) counts as a
blank. The fit reads ``FIT_PER_LANG`` texts a language and ``FIT_ROWS`` in all, at most, picked by a hash of doc_id: the least
of the ``PART_ROWS`` least of each of ``PARTS`` parts of a language, so no task gets a language's rows. Executors reduce them
to their places, so ``FIT_ROWS`` x 8 KB come to the driver whatever the lengths of texts. Whole texts are scored, slice by slice.

Defined results: ``und`` with score 0 where text is null or has no letter, or where nothing could be learned; ties go to
the language that sorts first; repeated rows are predicted alike; an empty table gives no rows; very long texts are read
slice by slice; other columns are not read, or pass through where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow, lean_batches

SLOTS_LOG = 16
MAX_N = 3
LANDMARKS, FIT_PER_LANG, FIT_ROWS = 96, 400, 4000
RIDGE = 1e-3
#: Parts of a language in which rows for the fit are picked first, and how many of each are.
PARTS, PART_ROWS = 256, 16
UNKNOWN = "und"
#: Characters of a text that are worked on at once.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _letters[0]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def presence(text: str, out: np.ndarray) -> None:
    """Mark the slots of the n-grams of a text in ``out`` (bool, SLOTS)."""
    text = text.lower()
    for a in range(0, len(text), SLICE):
        part = text[max(0, a - MAX_N + 1) : a + SLICE]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(letters()[c], c, 32).astype(np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, min(MAX_N, len(c)) + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out[mixed >> np.uint32(32 - SLOTS_LOG)] = True


def presence_matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << SLOTS_LOG), bool)
    for i, t in enumerate(texts):
        presence(t, out[i])
    return out


class Model:
    """``langs`` in order; ``landmarks``: presence in the slots ``at`` over the root of its number; ``weights``: kernel values to scores."""

    def __init__(self, langs: list[str], at: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.at, self.landmarks, self.weights = langs, at, landmarks, weights

    def kernel(self, p: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(1, p.sum(1))).astype(np.float32)
        return (p[:, self.at].astype(np.float32) @ self.landmarks.T) / own[:, None]

    def scores(self, p: np.ndarray) -> np.ndarray:
        return self.kernel(p) @ self.weights


def _packed(text: str) -> bytes:
    out = np.zeros(1 << SLOTS_LOG, bool)
    presence(text, out)
    return np.packbits(out).tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), "u1")).reshape(len(rows), -1).astype(bool)


def fit(texts: list[str], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on texts with letters."""
    return fit_packed([_packed(t) for t in texts], langs, n_landmarks, ridge)


def fit_packed(texts: list[bytes], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on texts as bits of their places. The landmarks are the first texts of each language in turn."""
    names = sorted(set(langs))
    if not names:
        return None
    turn: dict[str, int] = {}
    order = []
    for i, k in enumerate(langs):
        turn[k] = turn.get(k, 0) + 1
        order.append((turn[k], k, i))
    marks = [i for _, _, i in sorted(order)[: max(n_landmarks, len(names))]]
    p = _unpacked([texts[i] for i in marks])
    at = np.nonzero(p.any(0))[0]
    root = np.sqrt(np.maximum(1, p.sum(1)))
    model = Model(names, at, (p[:, at] / root[:, None]).astype(np.float32), np.zeros((len(marks), len(names)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(p).astype(np.float64))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    k = np.concatenate([model.kernel(_unpacked(texts[a : a + 128])) for a in range(0, len(texts), 128)]).astype(np.float64)
    f = k @ whiten
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([langs.count(x) for x in names]) / len(langs)
    row = np.array([1 / (len(names) * share[names.index(x)]) for x in langs])  # languages weigh alike
    w = np.linalg.solve(f.T @ (f * row[:, None]) + ridge * len(texts) * np.eye(f.shape[1]), f.T @ (y * row[:, None]))
    model.weights = (whiten @ w).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    x = x.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keys = x.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    # First within parts of a language, as one may hold most rows; what is left of all parts is bounded.
    part = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    keys = keys.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= PART_ROWS)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    keys = keys.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= FIT_PER_LANG).orderBy("_r", "lang").limit(FIT_ROWS)
    few = F.broadcast(keys.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_r"))  # FIT_ROWS rows at most
    rows = x.join(few, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "_r", "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([_packed(t) if has_letter(t) else None for t in b.column(3).to_pylist()], pa.binary())], names=["lang", "_r", "doc_id", "bits"])

    bits = rows.mapInArrow(pack, "lang string, _r int, doc_id long, bits binary").where("bits is not null")
    got = bits.orderBy("_r", "lang", "bits").limit(FIT_ROWS).collect()  # FIT_ROWS x 8 KB
    return fit_packed([bytes(r.bits) for r in got], [r.lang for r in got])


PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_batch(model: Model | None, texts: list) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    live = [i for i, t in enumerate(texts) if model and has_letter(t)]
    for a in range(0, len(live), 64):
        some = live[a : a + 64]
        s = model.scores(presence_matrix([texts[i] for i in some]))
        for i, k, v in zip(some, s.argmax(1), s.max(1), strict=True):
            langs[i], scores[i] = model.langs[k], float(np.clip((v + 1) / 2, 0, 1))
    return langs, scores


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_batch(sent.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow(PREDICTED))

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(lean_batches(run), PREDICTED)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all their columns, whose language could be told; where nothing could be learned, those with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            told = [x != UNKNOWN for x in predict_batch(sent.value, texts)[0]] if sent.value else [has_letter(t) for t in texts]
            yield b.filter(pa.array(told, pa.bool_()))

    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lean_batches(run), docs.schema)

"""Language-model scores by stupid backoff (operator 9).

score(w | context) = count(context w) / count(context) if the n-gram was counted ``min_count`` times or more, else
``ALPHA`` times the score with a context shorter by a word (so too where a document begins); a single word scores
count(w) / (number of all words). A document's ``log_score`` is the sum of the logarithms over its words, ``mean_score`` that by the word.

The counts are those of all documents, so a document vouches for its own n-grams. ``rest_score`` is the mean by the word
under the model of all other documents: its own counts are taken off each n-gram, each context and the number of words, and a
word that no other document has counts as one. It is what tells a text that occurs again from one that occurs once.

The n-grams of each chunk of documents are exploded and reduced to distinct ones with their numbers; they are dealt by
ranges of their 64-bit hash. A task holds one part of the count table, joins the chunks'
n-grams to it and sends the counts back in the order in which they came, so that neither n-grams nor their hashes
travel twice; the chunk sums them per document. A frequent n-gram comes once from each chunk.

Defined results: words are runs of letters, digits and underscores in lower case; null, empty and wordless texts have
0 words, score 0 and null means; a text longer than a chunk is a chunk of its own; repeated rows are counted and scored each; an
empty table gives no rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Chunk, Scratch, arrow, chunk_store
from quern.llm.jaccard import mix, word_hashes

#: Words of the longest n-gram; n-grams counted less often are unseen; weight of a step back.
ORDER, MIN_COUNT, ALPHA = 3, 1, 0.4
#: N-grams of one length in one task, about; text of a chunk, and of it what is hashed at once. A chunk sends a row to each task and length, so rows grow with chunks x tasks.
TASK_NGRAMS, LM_CHUNK_BYTES, SLICE = 3_000_000, 8 << 20, 1 << 20

_CHUNK = ("ids", "rows", "null_ids", "lens", "blob")
DEALT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("numbers", T.BinaryType())])
COUNTED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("words", T.LongType()), T.StructField("counts", T.BinaryType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_score", T.DoubleType()), T.StructField("rest_score", T.DoubleType())])


def squeeze(x: np.ndarray, z) -> bytes:
    """Compressed bytes of an integer array, by byte planes."""
    return z.compress(x.view("u1").reshape(-1, x.itemsize).T.tobytes())


def spread(b: bytes, kind: str, n: int, z) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(z.decompress(b, max_output_size=max(1, n * size)), "u1").reshape(size, n).T).view(kind).ravel()


def ngrams(c: Chunk, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes by length 1 .. order, document of each word); the n-gram at i ends with word i, and is 0 where the document is too short before it."""
    # Some documents at once, as hashing takes 40 bytes a character on the way.
    words, docs, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(c.lens):
        z = max(a + 1, int(np.searchsorted(c.off, c.off[a] + SLICE, side="right")) - 1)
        w, d = word_hashes([c.raw[c.off[i] : c.off[i + 1]].decode("utf-8", "surrogatepass") for i in range(a, z)])
        words.append(w)
        docs.append(d + a)
        a = z
    word, doc = np.concatenate(words), np.concatenate(docs)
    out = [mix(word + np.uint64(1)) | np.uint64(1)]
    for n in range(2, order + 1):
        h = np.zeros(len(word), np.uint64)
        if len(word) >= n:
            whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
            h[n - 1 :] = np.where(whole, mix(out[-1][n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + word[: len(word) - n + 1] + np.uint64(n)) | np.uint64(1), 0)
        out.append(h)
    return out, doc


def distinct(hashes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted distinct hashes, their numbers, place among them of each) for each length; 0 is none."""
    out = []
    for h in hashes:
        u, at, many = np.unique(h, return_inverse=True, return_counts=True)
        if len(u) and u[0] == 0:
            u, many, at = u[1:], many[1:], at - 1
        out.append((u, many, at))
    return out


def _bounds(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ranges of the buckets begin and end in sorted hashes."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(u, edges), [len(u)]]).astype(np.int64)


def _explode(buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for r in b.to_pylist():
                hashes, _ = ngrams(Chunk(*[r[x] for x in _CHUNK]), order)
                rows = []
                for n, (u, many, _) in enumerate(distinct(hashes), 1):
                    e = _bounds(u, buckets)
                    for i in range(buckets):
                        part = u[e[i] : e[i + 1]]
                        if len(part):
                            gaps = np.diff(part, prepend=np.uint64(0))
                            rows.append({"bucket": i * order + n - 1, "chunk_id": r["chunk_id"], "n": len(part), "hashes": squeeze(gaps, z), "numbers": squeeze(many[e[i] : e[i + 1]].astype("<u4"), z)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow(DEALT))

    return run


def _count(f: pd.DataFrame) -> pd.DataFrame:
    """One part of the count table, joined to the chunks' n-grams."""
    import zstandard

    d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    parts = [np.cumsum(spread(b, "<u8", n, d), dtype=np.uint64) for b, n in zip(f.hashes, f.n, strict=True)]
    numbers = [spread(b, "<u4", n, d) for b, n in zip(f.numbers, f.n, strict=True)]
    h, many = np.concatenate(parts), np.concatenate(numbers)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    table = np.add.reduceat(many[order].astype(np.int64), np.nonzero(new)[0])
    counts = np.empty(len(h), np.int64)
    counts[order] = table[np.cumsum(new) - 1]
    e = np.concatenate([[0], np.cumsum(f.n.to_numpy())])
    out = [(b, c, int(m.sum()), squeeze(np.ascontiguousarray(counts[e[i] : e[i + 1]]), z)) for i, (b, c, m) in enumerate(zip(f.bucket, f.chunk_id, numbers, strict=True))]
    return pd.DataFrame(out, columns=COUNTED.names)


def before(seen: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of the contexts of the n-grams that end with each word, by length: those of a word less that end with the word before."""
    return [seen[0], *[np.concatenate([np.zeros(min(1, len(x)), x.dtype), x[:-1]]) for x in seen[:-1]]]


def own_counts(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often the n-gram at each place occurs in its own document."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])[: len(x)]
    first = np.nonzero(new)[0]
    out = np.empty(len(h), np.int64)
    out[order] = np.diff(np.concatenate([first, [len(h)]]))[np.cumsum(new) - 1] if len(h) else 0
    return out


def backoff(seen: list[np.ndarray], context: list[np.ndarray], total: int | np.ndarray, min_count: int, alpha: float) -> np.ndarray:
    """Scores of words from the counts of the n-grams that end with them and of those n-grams' contexts, by length."""
    s = seen[0] / np.maximum(1, total)
    for n in range(1, len(seen)):
        s = np.where(seen[n] >= min_count, seen[n] / np.maximum(1, context[n]), alpha * s)
    return s


def _score(buckets: int, order: int, total: int, min_count: int, alpha: float):
    def run(chunks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if not len(chunks):
            return pd.DataFrame([], columns=SCORED.names)
        d = zstandard.ZstdDecompressor()
        c = Chunk(*[chunks[x].iloc[0] for x in _CHUNK])
        hashes, doc = ngrams(c, order)
        blobs = dict(zip(counted.bucket, counted.counts, strict=True)) if len(counted) else {}
        seen = []
        for n, (u, _, at) in enumerate(distinct(hashes)):
            e = _bounds(u, buckets)
            table = np.zeros(len(u) + 1, np.int64)
            for i in range(buckets):
                if e[i] < e[i + 1]:
                    table[e[i] : e[i + 1]] = spread(blobs[i * order + n], "<i8", int(e[i + 1] - e[i]), d)
            seen.append(table[at] if len(at) else np.zeros(0, np.int64))  # place -1 is no n-gram: its count is the 0 at the end
        n_words = np.bincount(doc, minlength=len(c.lens))
        logs = np.log(backoff(seen, before(seen), total, min_count, alpha))
        sums = np.bincount(doc, weights=logs, minlength=len(c.lens))
        rest = [np.maximum(0, x - own_counts(doc, h)) for x, h in zip(seen, hashes, strict=True)]
        rest[0] = np.maximum(1, rest[0])
        logs = np.log(backoff(rest, before(rest), np.maximum(1, total - n_words[doc]), min_count, alpha))
        rests = np.bincount(doc, weights=logs, minlength=len(c.lens))
        by = np.where(n_words > 0, n_words, np.nan)
        out = pd.DataFrame({"doc_id": c.doc_ids(), "n_words": n_words, "log_score": sums, "mean_score": sums / by, "rest_score": rests / by})
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.astype({"mean_score": "Float64", "rest_score": "Float64"})

    return run


def score_documents(docs: DataFrame, scratch: Scratch, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA) -> DataFrame:
    """One row a document: doc_id, n_words, log_score, mean_score, rest_score."""
    store = scratch.save(chunk_store(docs, LM_CHUNK_BYTES), "chunks", "uncompressed").select("chunk_id", "n_bytes", *_CHUNK)
    n_bytes = store.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2, -(-n_bytes // (6 * TASK_NGRAMS)))
    dealt = store.drop("n_bytes").mapInArrow(_explode(buckets, order), DEALT)
    counted = scratch.save(dealt.groupBy("bucket").applyInPandas(_count, COUNTED), "counts", "uncompressed")
    total = counted.where(F.col("bucket") % order == 0).agg(F.sum("words")).first()[0] or 0
    return store.drop("n_bytes").groupBy("chunk_id").cogroup(counted.drop("words").groupBy("chunk_id")).applyInPandas(_score(buckets, order, total, min_count, alpha), SCORED)

"""Suffix-array dedup (operator 2): bytes that belong to a repeated string of ``window`` bytes are removed from later places.

Suffixes are sorted by the difference-cover algorithm: triples at places 1 and 2 mod 3 are sorted and named, the names'
string is solved by recursion, the other suffixes are sorted by one symbol and a rank, and both are merged; then prefixes
of neighbours are compared. It is distributed by content, so that no task sees more than a bounded part:

1. Every window of ``window`` bytes has an anchor, the least hash among the ``K``-byte strings in it (leftmost if equal).
   Equal windows have equal anchors at equal offsets, so what isn't met at a common anchor cannot be equal. Successive
   windows with one anchor are a context, 100 to 152 bytes; anchors are one in 25 bytes.
2. Contexts are dealt by anchor. Of equal contexts (by two independent 64-bit hashes) all but the first lie in later copies. Most are settled thus; what
   stays are anchors with several different contexts, where copies begin or end: about 2 % of all windows.
3. Those contexts' bytes are dealt by anchor again and suffix-sorted there, in batches. An anchor with very many
   contexts is split by its windows' hashes, where copies are dropped before they are sent.
4. Removed windows return to their chunk of documents, which cuts the bytes.

Documents travel as compressed chunks of a table in the shared folder.

Defined results: null text is empty; texts shorter than the window stay; of rows with equal doc_id the one read first is
earlier, so repeated rows are later copies; a null doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Chunk, Scratch, arrow, chunk_store, lean_batches, lean_frame, lean_frames
from quern.llm.jaccard import mix, powers

WINDOW, K = 100, 48
#: Anchors of one task, bytes of contexts of one task and of one suffix sort, contexts of an anchor beyond which it is split, bytes that are hashed at once.
TASK_ANCHORS, TASK_BYTES, SORT_BYTES, HOT_CONTEXTS, SLICE = 600_000, 8 << 20, 1 << 19, 4000, 1 << 19

_PLACE_BITS = np.uint64(23)

#: For the second hash of a context: a number for each byte, the base, its powers and their inverses so far.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BASE = 0xA0761D6478BD642F
_second: list[np.ndarray] = []


def _second_powers(n: int) -> list[np.ndarray]:
    if not _second or len(_second[0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _second[:] = out
    return _second


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive integers, by the difference cover {1, 2} mod 3."""
    n = len(t)
    if n < 24:
        x = t.tolist()
        return np.array(sorted(range(n), key=lambda i: x[i:]), np.int64)
    t = t.astype(np.int64)
    if int(t.max()) > n + 256:
        t = _dense(t)
    a = int(t.max()) + 1
    wide = 2 * a.bit_length() + max(a, n + 3).bit_length() > 62
    tp = np.concatenate([t, np.zeros(3, np.int64)])
    pairs = tp[:-1] * a + tp[1:]
    if wide:
        pairs = _dense(pairs)
    # Sort the sampled triples and name them.
    end = n + (n % 3 == 1)
    ones, twos = np.arange(1, end, 3), np.arange(2, end, 3)
    sample = np.concatenate([ones, twos])
    triple = pairs[sample] * a + tp[sample + 2]
    order = np.argsort(triple, kind="stable")
    step = np.concatenate([[1], (np.diff(triple[order]) != 0).astype(np.int64)])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(step)
    # Recurse on the names unless they differ already.
    by_rank = order if int(names[order[-1]]) == len(sample) else suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[by_rank]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    sampled = sample[by_rank]
    sampled = sampled[sampled < n]
    # Sort the other suffixes by a symbol and a rank, and merge: each counts the sampled ones before it.
    m = n + 3
    rest = np.arange(0, n, 3)
    one = lambda i: tp[i] * m + rank[i + 1]
    two = lambda i: pairs[i] * m + rank[np.minimum(i + 2, n + 2)]
    rest = rest[np.argsort(one(rest), kind="stable")]
    s1, s2 = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    at = np.arange(len(rest)) + np.searchsorted(one(s1), one(rest)) + np.searchsorted(two(s2), two(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sampled
    return out


def later_windows(text: np.ndarray, starts: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at ``starts`` also start at a smaller place: sort suffixes, compare adjacent prefixes."""
    sa = suffix_array(text.astype(np.int64) + 1)
    which = np.full(len(text), -1, np.int64)
    which[starts] = np.arange(len(starts))
    order = which[sa]
    order = order[order >= 0]
    p = starts[order]
    same = np.zeros(len(p), bool)
    span = np.arange(window)
    for i in range(1, len(p), 1 << 14):
        b = p[i : i + (1 << 14)]
        a = p[i - 1 : i - 1 + len(b)]
        same[i : i + len(b)] = (text[a[:, None] + span] == text[b[:, None] + span]).all(1)
    run = np.cumsum(~same) - 1
    least = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, run, place[order])
    out = np.zeros(len(starts), bool)
    out[order] = place[order] > least[run]
    return out


def contexts(c: Chunk, window: int = WINDOW, k: int = K, slice_bytes: int = SLICE) -> dict[str, np.ndarray]:
    """The contexts of a chunk: anchor hash, two independent hashes of the context, first window's place, number of windows, document."""
    parts: list[tuple[np.ndarray, ...]] = []
    n = len(c.buf)
    # Windows inside a document, as a mask over their starts.
    live = c.lens >= window
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, c.off[:-1][live], 1)
    np.add.at(step, c.off[1:][live] - window + 1, -1)
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    w = window - k + 1
    for a in range(0, n - window + 1, slice_bytes):
        buf = c.buf[a : a + slice_bytes + window - 1]
        size = len(buf)
        power, inverse = powers(size + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:size], dtype=np.uint64)])
        h = mix((sums[k:] - sums[:-k]) * inverse[: size - k + 1])
        low = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while s < w:
            t = min(s, w - s)
            low = np.minimum(low[:-t], low[t:])
            s += t
        at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        ok = valid[a : a + len(at)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
        first, last = np.nonzero(new)[0], np.nonzero(last)[0]
        many = last - first + 1
        ctx = mix((sums[last + window] - sums[first]) * inverse[first] + (many * 64 + at[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        power, inverse = _second_powers(size + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * power[:size], dtype=np.uint64)])
        ctx2 = mix((sums[last + window] - sums[first]) * inverse[first] + (many * 64 + at[first] - first).astype(np.uint64))
        parts.append((h[at[first]], ctx, ctx2, first + a, many))
    none = [np.zeros(0, x) for x in (np.uint64, np.uint64, np.uint64, np.int64, np.int64)]
    anchor, ctx, ctx2, first, many = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
    return {"anchor": anchor, "ctx": ctx, "ctx2": ctx2, "start": first, "many": many, "doc": np.searchsorted(c.off, first, side="right") - 1}


def _order(c: Chunk) -> np.ndarray:
    """doc_id of each document of a chunk, as it counts for the order (null first)."""
    return np.where(c.null == 1, np.iinfo(np.int64).min, c.ids)


DEALT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk_id", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("anchor", "ctx", "ctx2", "doc", "start", "many", "gone_start", "gone_many")]])
SETTLED = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("n_open", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("gone_start", "gone_many", "open_anchor", "open_start", "open_many", "open_hot")]])
OPEN = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk_id", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("anchor", "doc", "start", "many", "bytes", "gone_start", "gone_many")]])
GONE = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("gone_start", T.BinaryType()), T.StructField("gone_many", T.BinaryType())])
_CHUNK = ("ids", "rows", "null_ids", "lens", "blob")


def _firsts(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys and place, which in that order are the first with their keys)."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _deal(buckets: int, window: int, k: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(*[r[x] for x in _CHUNK])
                x = contexts(c, window, k, slice_bytes)
                doc = _order(c)[x["doc"]]
                order, new = _firsts([x["anchor"], x["ctx"], x["ctx2"]], [doc, x["start"]])
                to = (x["anchor"] % np.uint64(buckets)).astype(np.int64)
                keep, gone = np.sort(order[new]), np.sort(order[~new])
                keep, gone = keep[np.argsort(to[keep], kind="stable")], gone[np.argsort(to[gone], kind="stable")]
                ke, ge = np.searchsorted(to[keep], np.arange(buckets + 1)), np.searchsorted(to[gone], np.arange(buckets + 1))
                out = []
                for i in range(buckets):
                    a, g = keep[ke[i] : ke[i + 1]], gone[ge[i] : ge[i + 1]]
                    if len(a):
                        out.append({"bucket": i, "chunk_id": r["chunk_id"], "anchor": x["anchor"][a].tobytes(), "ctx": x["ctx"][a].tobytes(), "ctx2": x["ctx2"][a].tobytes(), "doc": doc[a].tobytes(), "start": x["start"][a].astype("<i8").tobytes(), "many": x["many"][a].astype("u1").tobytes(), "gone_start": x["start"][g].astype("<i8").tobytes(), "gone_many": x["many"][g].astype("u1").tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=arrow(DEALT))

    return run


def _joined(f: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(f[name]), kind)


def _settle(hot_contexts: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Settles the contexts of a bucket: later copies of equal ones are gone, those of an anchor with several stay open."""
        f = f.sort_values("chunk_id").reset_index(drop=True)
        row = np.repeat(np.arange(len(f)), [len(x) for x in f.many])
        anchor, ctx, ctx2, doc, start, many = _joined(f, "anchor", "<u8"), _joined(f, "ctx", "<u8"), _joined(f, "ctx2", "<u8"), _joined(f, "doc", "<i8"), _joined(f, "start", "<i8"), _joined(f, "many", "u1")
        order, new = _firsts([anchor, ctx, ctx2], [doc, row, start])
        gone = np.sort(order[~new])
        reps = order[new]
        same = np.concatenate([[False], anchor[reps][1:] == anchor[reps][:-1]])
        group = np.cumsum(~same) - 1
        size = np.bincount(group, minlength=1)[group]
        is_open = np.sort(reps[size > 1])
        hot = np.zeros(len(anchor), "u1")
        hot[reps] = size > hot_contexts
        out = []
        ge, oe = np.searchsorted(row[gone], np.arange(len(f) + 1)), np.searchsorted(row[is_open], np.arange(len(f) + 1))
        for i in range(len(f)):
            g, o = gone[ge[i] : ge[i + 1]], is_open[oe[i] : oe[i + 1]]
            out.append((f.chunk_id[i], len(o), f.gone_start[i] + start[g].tobytes(), f.gone_many[i] + many[g].tobytes(), anchor[o].tobytes(), start[o].tobytes(), many[o].tobytes(), hot[o].tobytes()))
        return pd.DataFrame(out, columns=SETTLED.names)

    return run


def _open(buckets: int, window: int):
    def run(chunks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The open contexts of a chunk with their bytes, dealt by anchor; hot ones window by window, dealt by the windows' hashes."""
        import zstandard

        if not len(chunks) or not len(asked):
            return pd.DataFrame([], columns=OPEN.names)
        c, z = Chunk(*[chunks[x].iloc[0] for x in _CHUNK]), zstandard.ZstdCompressor(level=1)
        anchor, start, many, hot = _joined(asked, "open_anchor", "<u8"), _joined(asked, "open_start", "<i8"), _joined(asked, "open_many", "u1").astype(np.int64), _joined(asked, "open_hot", "u1") == 1
        gone_start, gone_to = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if hot.any():
            singles = np.concatenate([np.arange(s, s + m) for s, m in zip(start[hot], many[hot], strict=True)])
            h, h2 = np.frombuffer(b"".join(hashlib.blake2b(c.raw[s : s + window], digest_size=16).digest() for s in singles), "<u8").reshape(-1, 2).T
            doc = _order(c)[np.searchsorted(c.off, singles, side="right") - 1]
            order, new = _firsts([h, h2], [doc, singles])
            gone_start, gone_to = singles[order[~new]], (h[order[~new]] % np.uint64(buckets)).astype(np.int64)
            keep = order[new]
            anchor, start, many = np.concatenate([anchor[~hot], h[keep]]), np.concatenate([start[~hot], singles[keep]]), np.concatenate([many[~hot], np.ones(len(keep), np.int64)])
        doc = _order(c)[np.searchsorted(c.off, start, side="right") - 1]
        to = (anchor // np.uint64(1 << 20) % np.uint64(buckets)).astype(np.int64)
        out = []
        for i in np.unique(np.concatenate([to, gone_to])):
            a, g = np.nonzero(to == i)[0], gone_start[gone_to == i]
            raw = b"".join(c.raw[s : s + m + window - 1] for s, m in zip(start[a], many[a], strict=True))
            out.append((i, chunks.chunk_id.iloc[0], anchor[a].tobytes(), doc[a].tobytes(), start[a].tobytes(), many[a].astype("u1").tobytes(), z.compress(raw), g.tobytes(), np.ones(len(g), "u1").tobytes()))
        return pd.DataFrame(out, columns=OPEN.names)

    return run


def _sort(window: int, sort_bytes: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Suffix-sorts the contexts of a bucket in batches of whole anchors."""
        import zstandard

        f = f.sort_values("chunk_id").reset_index(drop=True)
        row = np.repeat(np.arange(len(f)), [len(x) for x in f.many])
        anchor, doc, start, many = _joined(f, "anchor", "<u8"), _joined(f, "doc", "<i8"), _joined(f, "start", "<i8"), _joined(f, "many", "u1").astype(np.int64)
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x, max_output_size=int(n)) if n else b"" for x, n in zip(f.bytes, np.bincount(row, weights=many + window - 1, minlength=len(f)), strict=True)), "u1")
        size = many + window - 1
        at = np.cumsum(size) - size
        order = np.lexsort((start, row, doc, anchor))
        place = np.empty(len(order), np.int64)  # of a context among all: by document, then start
        by_place = np.lexsort((start, row, doc))
        place[by_place] = np.arange(len(order))
        ends = np.cumsum(size[order])
        gone: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(order):
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + sort_bytes, side="right"))
            z = max(a + 1, z)
            last = anchor[order[z - 1]]
            z = int(np.searchsorted(anchor[order], last, side="right"))  # the whole anchor
            some = order[a:z]
            n = size[some]
            begin = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(begin, n)
            symbols = text[np.repeat(at[some], n) + inner]
            is_start = inner < np.repeat(many[some], n)
            starts = np.nonzero(is_start)[0]
            whose = np.repeat(np.arange(len(some)), n)[starts]
            # Places of windows: context by context in document order, then by offset.
            later = later_windows(symbols, starts, (place[some[whose]] << 8) + inner[starts], window)
            hit = starts[later]
            gone.append((some[whose[later]], start[some[whose[later]]] + inner[hit]))
            a = z
        rows = np.concatenate([row[x] for x, _ in gone]) if gone else np.zeros(0, np.int64)
        begins = np.concatenate([y for _, y in gone]) if gone else np.zeros(0, np.int64)
        by = np.lexsort((begins, rows))
        rows, begins = rows[by], begins[by]
        e = np.searchsorted(rows, np.arange(len(f) + 1))
        out = []
        for i in range(len(f)):
            s = begins[e[i] : e[i + 1]]
            new = np.concatenate([[True], np.diff(s) != 1]) if len(s) else np.zeros(0, bool)
            first = np.nonzero(new)[0]
            runs = np.diff(np.concatenate([first, [len(s)]]))
            # Lengths travel as bytes: a longer run goes as several.
            s2, m2 = [], []
            for p, m in zip(s[first], runs, strict=True):
                while m > 0:
                    s2.append(p)
                    m2.append(min(m, 255))
                    p, m = p + 255, m - 255
            out.append((f.chunk_id[i], f.gone_start[i] + np.array(s2, "<i8").tobytes(), f.gone_many[i] + np.array(m2, "u1").tobytes()))
        return pd.DataFrame(out, columns=GONE.names)

    return run


CUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])


def _cut(window: int, with_text: bool):
    def run(chunks: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame([], columns=CUT.names)
        c = Chunk(*[chunks[x].iloc[0] for x in _CHUNK])
        start, many = (_joined(gone, "gone_start", "<i8"), _joined(gone, "gone_many", "u1").astype(np.int64)) if len(gone) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        depth = np.zeros(len(c.buf) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + many + window - 1, -1)
        out_of = np.cumsum(depth[:-1]) > 0
        rows = []
        for i, k in enumerate(c.doc_ids()):
            a, z = int(c.off[i]), int(c.off[i + 1])
            m = out_of[a:z]
            n = int(m.sum())
            kept = c.buf[a:z][~m].tobytes() if n else c.raw[a:z]
            spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if n else 0
            rows.append((k, int(c.rows[i]), z - a, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        out = pd.DataFrame(rows, columns=CUT.names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def suffix_dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = K, row: str | None = None, with_text: bool = False, hot_contexts: int = HOT_CONTEXTS, sort_bytes: int = SORT_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """One row a document: doc_id, row, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, text (the rest; characters cut in two are dropped)."""
    if not 0 < k <= window <= 200 or window - k >= 64:
        raise ValueError("anchors need k <= window < k + 64, and windows 200 bytes at most")
    store = scratch.save(chunk_store(docs, row=row), "chunks", "uncompressed")
    n_bytes = store.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2, -(-int(n_bytes * 2.2 / (window - k + 2)) // TASK_ANCHORS))
    chunk_cols = store.select("chunk_id", *_CHUNK)
    dealt = chunk_cols.mapInArrow(lean_batches(_deal(buckets, window, k, slice_bytes)), DEALT)
    settled = scratch.save(dealt.groupBy("bucket").applyInPandas(lean_frame(_settle(hot_contexts)), SETTLED), "settled")
    n_open = settled.agg(F.sum("n_open")).first()[0] or 0
    open_buckets = max(2, -(-n_open * (window + 30) // TASK_BYTES))
    asked = settled.where("n_open > 0").select("chunk_id", "open_anchor", "open_start", "open_many", "open_hot")
    opened = chunk_cols.groupBy("chunk_id").cogroup(asked.groupBy("chunk_id")).applyInPandas(lean_frames(_open(open_buckets, window)), OPEN)
    gone = scratch.save(opened.groupBy("bucket").applyInPandas(lean_frame(_sort(window, sort_bytes)), GONE), "gone")
    gone = gone.unionByName(settled.select("chunk_id", "gone_start", "gone_many"))
    return chunk_cols.groupBy("chunk_id").cogroup(gone.groupBy("chunk_id")).applyInPandas(lean_frames(_cut(window, with_text)), CUT)

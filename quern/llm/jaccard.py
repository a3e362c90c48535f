"""N-gram Jaccard join by MinHash banding (operator 6).

A text is the set of its shingles: ``n`` successive words (lower case, letters, digits and underscores); a text with fewer
words is one shingle. Equal sets are one class with one representative. Band and row counts follow from the threshold and
the recall that is asked for; classes meet on band hashes, and classes that meet, directly or through others, form a
candidate group. Pairs are verified on the full shingle sets, by whichever way moves less text: all pairs of a group (a group of true
copies meets in nearly all of its pairs anyway), or, in a large group whose members hang together by chains, only the pairs that share a band,
bucket by bucket, each pair in the first band that it shares; buckets with the same members count once. Both ways find
every pair that shares a band, so recall is that of the banding or above, and no group costs more than its buckets do.

Groups and buckets are cut into blocks, and pairs of blocks are tasks; links are counted there and never become rows:
a task returns for each class how many documents it is linked to and one edge to a linked class, as a forest.

Defined results: null counts as empty; texts without words have no links and are classes of their own; copies and
repeated rows are linked to each other; a null doc_id comes before all others; very long texts are one set like others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, arrow, chunks_of, even_join, lean_batches, whole_text
from quern.llm.graph import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 160
#: Classes that are verified in one block; shingle columns of one matrix product.
BLOCK, COLUMNS = 128, 8192

#: Stands for a null doc_id on the way.
NO_ID = -(1 << 63)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands that ``recall`` takes at the threshold need ``most`` hashes at most."""
    fits = []
    for r in range(1, most + 1):
        p = threshold**r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if b * r <= most:
            fits.append((r, b))
    r, b = max(fits)
    return b, r


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_words: list[np.ndarray] = []
_powers: list[np.ndarray] = []


def word_chars() -> np.ndarray:
    if not _words:
        _words.append(np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)], bool))
    return _words[0]


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word, in order: runs of letters, digits and underscores in lower case. Texts are taken end to end, so cost is by character."""
    low = [t.lower() for t in texts]
    c = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
    is_word = word_chars()[c]
    step = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    start, stop = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = powers(len(c) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * power[: len(c)], dtype=np.uint64)])
    word = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return word, np.searchsorted(ends, start, side="right")


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, document of each), documents in order."""
    word, doc = word_hashes(texts)
    if not len(word):
        return word, doc
    out, owner = [], []
    if len(word) >= n:
        full = np.zeros(len(word) - n + 1, np.uint64)
        for j in range(n):
            full = mix(full + word[j : len(word) - n + 1 + j] + np.uint64(j + 1))
        inside = doc[: len(full)] == doc[n - 1 :]
        out.append(full[inside])
        owner.append(doc[: len(full)][inside])
    counts = np.bincount(doc, minlength=len(texts))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for d in np.nonzero((counts > 0) & (counts < n))[0]:
        h = np.array([counts[d]], np.uint64)
        for w in word[firsts[d] : firsts[d + 1]]:
            h = mix(h + w)
        out.append(h)
        owner.append(np.array([d]))
    h, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def signatures(h: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (documents, hashes) of the runs of h that begin at ``starts``."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    c = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    x, y = (h >> np.uint64(32)).astype(np.uint32), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    for k in range(hashes):
        v = (x ^ c[k]) * a[k] + y
        v = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def digest(shingle_set: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(shingle_set.tobytes())


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, cls (digest of the shingle set), size (shingles), bands (a hash for each); docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks_of(batches, limit=1 << 20):
            h, owner = shingles([t or "" for t in texts], n)
            has, starts = np.unique(owner, return_index=True)
            band_of: dict[int, list] = {}
            if len(has):
                sig = signatures(h, starts, bands * rows).astype(np.uint64)
                b = np.zeros((len(has), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[None, :]
                for r in range(rows):
                    b = mix(b * _M1 + sig[:, r::rows][:, :bands])
                band_of = dict(zip(has.tolist(), b.view(np.int64).tolist(), strict=True))
            cls: list[str] = []
            size: list[int] = []
            stops = dict(zip(has.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(h)][: len(has)], strict=True), strict=True))
            for i, k in enumerate(ids):
                if i in stops:
                    s = np.unique(h[slice(*stops[i])])
                    cls.append(digest(s))
                    size.append(len(s))
                else:
                    cls.append(f"-{k}")
                    size.append(0)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "cls": cls, "size": size, "bands": [band_of.get(i, []) for i in range(len(ids))]}, schema=arrow(SKETCH))

    return docs.mapInArrow(lean_batches(run), SKETCH)


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix: which of ``sets`` reach the threshold with which of ``others`` (or of themselves)."""
    both = sets if others is None else [*sets, *others]
    m = len(sets)
    size = np.array([len(s) for s in both])
    values, owner = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1  # a shingle of one set alone is in no intersection
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    cols = int(shared.sum())
    common = np.zeros((m, len(both) if others is None else len(others)), np.float32)
    edges = np.searchsorted(column, np.arange(0, cols + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        a, z = edges[k], edges[k + 1]
        if a < z:
            x = np.zeros((len(both), COLUMNS), np.float32)
            x[owner[a:z], column[a:z] - k * COLUMNS] = 1
            common += x[:m] @ (x.T if others is None else x[m:].T)
    other_size = size if others is None else size[m:]
    return common >= threshold * (size[:m, None] + other_size[None, :] - common) - 1e-4


VERIFIED = T.StructType([T.StructField("cls", T.StringType()), T.StructField("links", T.LongType()), T.StructField("peer", T.StringType())])


def _forest(hit: np.ndarray, left: list[str], right: list[str]) -> dict[str, str]:
    """An edge for each class that is linked to one before it, so that linked classes hang together."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out: dict[str, str] = {}
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = find(left[i]), find(right[j])
        if a != b:
            a, b = max(a, b), min(a, b)
            root[a] = b
            out[a] = b
    return out


def verify(groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """Rows (cls, links, peer) from (unit, at, x, y, block, cls, copies, bands, text): one group of rows for each pair of blocks x <= y.

    Where ``at`` is set the unit is the bucket of band ``at``, and pairs that share a band before it are left to that one.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        h, owner = shingles(list(f.text), n)
        cut = np.searchsorted(owner, np.arange(len(f) + 1))
        sets = [np.unique(h[cut[i] : cut[i + 1]]) for i in range(len(f))]
        f = f.assign(place=range(len(f)))[[digest(s) == c for s, c in zip(sets, f.cls, strict=True)]].drop_duplicates("cls")
        sets = [sets[i] for i in f["place"]]
        names, copies = list(f.cls), f.copies.to_numpy(np.int64)
        first = (f.block == f.x).to_numpy()
        at = int(f["at"].iloc[0]) if len(f) else -1
        bands = np.array(f.bands.tolist(), np.int64).reshape(len(f), -1)[:, : max(0, at)] if at >= 0 else None

        def here(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Pairs that are this unit's own."""
            out = np.ones((len(a), len(b)), bool)
            if bands is not None:
                for k in range(bands.shape[1]):
                    out &= bands[a, k][:, None] != bands[b, k][None, :]
            return out

        rows: list[tuple] = []
        if (f.x == f.y).all():
            every = np.arange(len(f))
            hit = linked(sets, None, threshold) & here(every, every)
            np.fill_diagonal(hit, False)
            total = hit @ copies
            forest = _forest(np.tril(hit), names, names)
            rows = [(c, int(t), forest.get(c)) for c, t in zip(names, total, strict=True) if t]
        elif first.any() and not first.all():
            a, b = np.nonzero(first)[0], np.nonzero(~first)[0]
            hit = linked([sets[i] for i in a], [sets[i] for i in b], threshold) & here(a, b)
            forest = _forest(hit, [names[i] for i in a], [names[i] for i in b])
            rows = [(names[i], int(t), forest.get(names[i])) for i, t in zip(a, hit @ copies[b], strict=True) if t]
            rows += [(names[i], int(t), forest.get(names[i])) for i, t in zip(b, hit.T @ copies[a], strict=True) if t]
        return pd.DataFrame(rows, columns=VERIFIED.names)

    return groups.groupBy("unit", "x", "y").applyInPandas(run, VERIFIED)


def jaccard_join(docs: DataFrame, scratch: Scratch, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id among the texts that links connect), copy_id (least doc_id with the same shingles), n_links (documents at the threshold or above, copies included)."""
    bands, rows = bands_for(threshold, recall, most_hashes)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text().alias("text"))
    sk = scratch.save(sketches(docs, n, bands, rows), "sketches")
    total = sk.count()
    classes = sk.groupBy("cls").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    classes = scratch.save(classes, "classes", rows=total)
    met = classes.where("size > 0").select("cls", F.posexplode("bands").alias("at", "band"))
    who = F.sum(F.xxhash64("cls").cast("decimal(38,0)"))
    buckets = met.groupBy("band", "at").agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("members"), who.alias("who")).where("members > 1")
    n_met = total * bands
    buckets = scratch.save(buckets, "buckets", rows=n_met // 2)
    own = F.xxhash64("cls", "band", F.lit("own"))
    edges = even_join(met.select("cls", "band"), buckets.select("band", "first", "members"), "band", "members", n_met, own).where(F.col("first").isNotNull() & (F.col("first") != F.col("cls")))
    comps = scratch.save(components(edges.select(F.col("cls").alias("u"), F.col("first").alias("v")), scratch, "met", rows=n_met), "met", rows=total)
    cost = lambda m: m * F.ceil(m / BLOCK)  # noqa: E731  members that travel
    sizes = comps.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    # Of buckets with the same members the first band's stays: it is the first that any two of them share.
    kept = buckets.groupBy("first", "members", "who").agg(F.min(F.struct("at", "band")).alias("b")).select("first", "members", "b.at", "b.band")
    by_band = kept.join(comps.withColumnRenamed("node", "first").hint("merge"), "first").groupBy("label").agg(F.sum(cost(F.col("members"))).alias("by_band"))
    sizes = sizes.join(by_band.hint("merge"), "label").select("label", "members", (F.col("by_band") < cost(F.col("members"))).alias("banded"))
    sizes = scratch.save(sizes, "sizes", rows=total // 2)
    member = even_join(comps, sizes, "label", "members", sizes.agg(F.sum("members")).first()[0] or 0, F.concat(F.lit("~"), F.col("node")))
    member = member.join(classes.select(F.col("cls").alias("node"), "copy_id", "copies", "bands").hint("merge"), "node").withColumnRenamed("node", "cls")
    no_bands = F.lit(None).cast("array<long>")
    units = member.where(~F.col("banded")).select("cls", F.col("label").alias("unit"), F.lit(-1).alias("at"), "members", no_bands.alias("bands"), "copy_id", "copies")
    if not sizes.where("banded").isEmpty():
        chained = member.where("banded").select("cls", "copy_id", "copies", "bands", F.posexplode("bands").alias("_at", "band"))
        chained = even_join(chained, kept.select("band", "at", "members"), "band", "members", n_met, own).where("at is not null")
        units = units.unionByName(chained.select("cls", F.concat_ws(":", "at", "band").alias("unit"), "at", "members", "bands", "copy_id", "copies"))
    units = units.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")).drop("members")
    units = scratch.save(units, "units")
    # The text of one document a class; where rows share a doc_id, verify() takes the one whose shingles are the class's.
    # By sort-merge at every size: a broadcast of few members would make plans differ between sizes.
    own_text = docs.join(units.withColumnRenamed("copy_id", "doc_id").hint("merge"), "doc_id").select("unit", "at", "block", "blocks", "cls", "copies", "bands", "text")
    pairs = own_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("unit", "at", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "copies", "bands", "text")
    found = scratch.save(verify(pairs, n, threshold), "verified")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    same = components(found.where("peer is not null").select(F.col("cls").alias("u"), F.col("peer").alias("v")), scratch, "linked", rows=n_met)
    known = classes.select("cls", "copy_id", "copies").join(links.hint("merge"), "cls", "left").join(same.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
    known = scratch.save(known.withColumn("label", F.coalesce("label", "cls")), "known", rows=total)
    least = known.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.sum("copies").alias("members"))
    known = even_join(known, least, "label", "members", total, F.concat(F.lit("~"), F.col("cls")))
    known = known.select("cls", "copy_id", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = even_join(sk.select("doc_id", "cls", "size"), known, "cls", "copies", total, F.concat(F.lit("~"), F.col("cls"), F.monotonically_increasing_id().cast("string")))
    ids = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "class_id", "copy_id")]
    return out.select(*ids, F.when(F.col("size") > 0, F.col("copies") - 1 + F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))

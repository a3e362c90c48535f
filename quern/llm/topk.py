"""Exact top-k search by inner product (operator 8).

Vectors are turned so that their directions of largest variance come first (SVD of the Gram matrix, which is summed over
all vectors and has d x d entries) and processed by descending length, in bands: the ``HEAD`` longest first, then bands that are each ``GROWTH``
times as large. After each band a query's threshold is its k-th best score so far, and queries that no shorter vector can serve
(Cauchy-Schwarz on the whole lengths) are done. Inside a band each task meets its candidates block by block, longest first, with
thresholds that rise as it goes. For a block of queries and one of candidates, partial sums over more and more leading turned
coordinates (``STAGES``) plus the Cauchy-Schwarz bound on the rest drop pairs; survivors get their exact integer product. Bounds carry
a margin for rounding, so nothing is lost.

Queries are broadcast in stripes of at most ``STRIPE_BYTES``, each of which meets all candidates where they lie: candidates are
dealt once, by length, and not shuffled again. The number of bands grows with the logarithm of the table.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part; shorter vectors count as
filled up with zeros; ties go to the smaller vec_id; of rows with equal vec_id each is a candidate, other than the
query's own id; an id is a query once for each of its rows' distinct vectors. No query or no candidate gives no row. Scores beyond 64 bits are cut to the
largest or smallest long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, arrow

#: Candidates of the first band; how much larger each next one is; queries and candidates in a block.
HEAD, GROWTH, QUERY_BLOCK, BLOCK = 2048, 8, 512, 2048
#: Shares of the coordinates after which pairs are dropped.
STAGES = (0.25, 0.5, 0.75, 0.875)
#: Queries that are broadcast at once.
STRIPE_BYTES = 32 << 20


def quantised(x: Column, scale: int = 1024) -> Column:
    """floor(scale * x), x as double; null if any component is null or not finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")))


def matrix(rows: list, d: int) -> np.ndarray:
    out = np.zeros((len(rows), d), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of rows of q and c, exact: in doubles where every sum stays below 2^53, else in Python integers, cut to 64 bits."""
    if not len(q) or not len(c) or not q.shape[1]:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    big = q.astype(object) @ c.astype(object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def gram(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of v v^T over all vectors: d x d numbers come to the driver, whatever the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b in batches:
            m = matrix(b.column(0).to_pylist(), d).astype(np.float64)
            g += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "v": g.ravel()}, schema=arrow(kind))

    kind = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
    out = np.zeros((d, d))
    for r in vectors.select("q").mapInArrow(run, kind).groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def rotation(g: np.ndarray) -> np.ndarray:
    """Orthogonal matrix with the directions of largest energy first."""
    if not g.size or not np.isfinite(g).all():
        return np.eye(len(g))
    return np.linalg.svd(g)[0]


def prune(turned: np.ndarray, qn: np.ndarray, tau: np.ndarray, c_turned: np.ndarray, cn: np.ndarray, stages: tuple[float, ...] = STAGES) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may reach the query's threshold: those that the bounds after all stages leave."""
    d = turned.shape[1]
    rows, cols = np.arange(len(turned)), np.arange(len(c_turned))
    alive = np.outer(qn, cn) * (1 + 1e-9) + 1e-6 >= tau[:, None]
    part = np.zeros(alive.shape)
    q_left, c_left = qn**2 * (1 + 1e-9), cn**2 * (1 + 1e-9)
    done = 0
    for share in stages:
        # Queries and candidates of which no pair is left take no further part.
        r, c = alive.any(1), alive.any(0)
        if not r.all() or not c.all():
            rows, cols, alive, part = rows[r], cols[c], alive[np.ix_(r, c)], part[np.ix_(r, c)]
        upto = max(done, min(d, round(share * d)))
        if upto == done or not alive.size:
            continue
        q, v = turned[rows, done:upto], c_turned[cols, done:upto]
        part = part + q @ v.T
        q_left[rows] -= (q**2).sum(1)
        c_left[cols] -= (v**2).sum(1)
        rest = np.outer(np.sqrt(np.maximum(0, q_left[rows])), np.sqrt(np.maximum(0, c_left[cols])))
        alive = alive & (part + rest + 1e-9 * np.outer(qn[rows], cn[cols]) + 1e-6 >= tau[rows, None])
        done = upto
    i, j = np.nonzero(alive)
    return rows[i], cols[j]


def pair_scores(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows i of q and j of c."""
    if not len(i):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
        out = [np.einsum("ij,ij->i", q[i[a : a + 65536]], c[j[a : a + 65536]]) for a in range(0, len(i), 65536)]
        return np.concatenate(out)
    return np.concatenate([exact_scores(q[a : a + 1], c[b : b + 1])[0] for a, b in zip(i, j, strict=True)])


class Best:
    """The k best of each query of a stripe so far: places are those of the stripe."""

    def __init__(self, tau: np.ndarray, k: int):
        self.tau, self.k = tau.copy(), k
        self.who, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        who, ids, scores = np.concatenate([self.who, who]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores.astype(np.float64), who)) if len(scores) and np.abs(scores).max() < 2**52 else np.array(sorted(range(len(who)), key=lambda x: (who[x], -int(scores[x]), ids[x])), np.int64)
        who, ids, scores = who[order], ids[order], scores[order]
        first = np.searchsorted(who, who, side="left")
        rank = np.arange(len(who)) - first
        keep = rank < self.k
        last = np.nonzero(rank == self.k - 1)[0]
        self.tau[who[last]] = np.maximum(self.tau[who[last]], scores[last])
        self.who, self.ids, self.scores = who[keep], ids[keep], scores[keep]


def search(queries: tuple[np.ndarray, ...], turn: np.ndarray, candidates: Iterator[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of queries, ids, scores) of the k best among the candidates, and the number of pairs that got an exact product.

    queries: ids, vectors, lengths, thresholds; candidates: blocks of ids, vectors and lengths, longest first.
    """
    q_ids, q, qn, tau = queries
    turned, found, exact = q.astype(np.float64) @ turn, Best(tau, k), 0
    for c_ids, c, cn in candidates:
        live = np.nonzero(qn * (float(cn.max(initial=0)) * (1 + 1e-9)) + 1e-6 >= found.tau)[0]
        c_turned = c.astype(np.float64) @ turn
        for a in range(0, len(live), QUERY_BLOCK):
            at = live[a : a + QUERY_BLOCK]
            i, j = prune(turned[at], qn[at], found.tau[at], c_turned, cn)
            i = at[i]
            other = q_ids[i] != c_ids[j]
            i, j = i[other], j[other]
            s = pair_scores(q, c, i, j)
            exact += len(i)
            better = s >= found.tau[i]
            found.add(i[better], c_ids[j[better]], s[better])
    return found.who, found.ids, found.scores, exact


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query"), quantised(F.col(vec_col), scale).alias("q"))
    x = x.where(F.col("q").isNotNull() & F.col("vec_id").isNotNull())
    x = x.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))
    x = scratch.save(x, "vectors")
    n_rows, d = x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    d = max(1, d)
    turn = rotation(gram(x, d))
    # By length, longest first: a table whose files each hold a range of lengths.
    dealt = x.select("vec_id", "q", "norm").repartitionByRange(max(1, -(-n_rows // (4 * BLOCK))), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    dealt = scratch.save(dealt, "by_length")
    edges, size = [], HEAD
    while size < n_rows:
        edges.append(1 - size / n_rows)
        size *= GROWTH
    # Lengths where bands end: a handful of numbers, exact enough, as any bands give the same result.
    cuts = list(x.agg(F.percentile_approx("norm", F.array(*map(F.lit, edges)), 10000)).first()[0]) if edges else []
    bands = list(zip([None, *cuts], [*cuts, None], strict=True))
    q_rows = scratch.save(x.where("is_query").select("vec_id", "q", "norm").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    n_queries = q_rows.count()
    stripes = max(1, -(-(n_queries * (8 * d + 32)) // STRIPE_BYTES))
    out_kind = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def met(band: DataFrame, stripe: list) -> DataFrame:
        """The k best of a band for a stripe of queries, by each task."""
        names = np.array([r["query"] for r in stripe], np.int64)
        mine = (np.array([r["vec_id"] for r in stripe], np.int64), matrix([r["q"] for r in stripe], d), np.array([r["norm"] for r in stripe]), np.array([-np.inf if r["tau"] is None else float(r["tau"]) for r in stripe]))
        sent = band.sparkSession.sparkContext.broadcast((names, mine, turn))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, mine, turn = sent.value

            def blocks() -> Iterator[tuple[np.ndarray, ...]]:
                for b in batches:
                    for i in range(0, b.num_rows, BLOCK):
                        part = b.slice(i, BLOCK)
                        yield part.column(0).to_numpy(), matrix(part.column(1).to_pylist(), d), part.column(2).to_numpy()

            who, ids, scores, _ = search(mine, turn, blocks(), k)
            yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(mine[0][who]), pa.array(ids), pa.array(scores)], schema=arrow(out_kind))

        return band.mapInArrow(run, out_kind)

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found = None
    for i, (longest, shortest) in enumerate(bands):
        band = dealt if longest is None else dealt.where(F.col("norm") < longest)
        band = band if shortest is None else band.where(F.col("norm") >= shortest)
        asked = q_rows.withColumn("tau", F.lit(None).cast("long"))
        if found is not None:
            kth = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("tau"))
            asked = q_rows.join(kth.hint("merge"), "query", "left")
            asked = asked.where(F.col("tau").isNull() | (F.col("norm") * (longest * (1 + 1e-9)) + 1e-6 >= F.col("tau")))
            asked = scratch.save(asked, f"asked_{i}") if stripes > 1 else asked
        more = None
        for s in range(stripes):
            stripe = asked.where(F.pmod(F.xxhash64("query"), F.lit(stripes)) == s).collect()  # STRIPE_BYTES, about
            if stripe:
                part = met(band, stripe)
                more = part if more is None else more.unionByName(part)
        if more is not None:
            found = scratch.save(ranked(more if found is None else found.unionByName(more)).drop("rank"), f"found_{i}")
    if found is None:
        found = x.sparkSession.createDataFrame([], out_kind)
    return ranked(found).select("query_id", "rank", "vec_id", "score")

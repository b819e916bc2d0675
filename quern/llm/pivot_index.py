"""Exact top-k search by inner product over a pivot-distance index.

Vectors are whole numbers here (``quantised``). One more coordinate brings all of them to the largest norm; then the largest inner product is the
smallest distance. Every vector is keyed by its nearest pivot and its distance from it, sorted by that key and cut into annuli of at most RING vectors.
A query first visits the annulus that its own key falls in, for a first bound, and then expands the others from the nearest outward; by the
triangle inequality no vector of an annulus [lo, hi] around pivot p is nearer than lo - d(q, p) or d(q, p) - hi, so a query stops where that
exceeds its k-th distance so far. Bounds are loosened by more than their rounding errors and scores are exact, so the result is exact.

Pivots are fitted by k-means on a bounded sample (SAMPLE_VALUES numbers); every vector is indexed. Equal vectors collapse to one that keeps its k + 1
smallest ids. Queries go to the executors in batches of QUERY_VALUES numbers, whose size is known before; the index is never moved.

Odd input: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; shorter vectors count as if filled
up with zeros; empty and zero vectors take part; a row that repeats id and vector counts once; rows with the query's id are not its candidates; a
norm of 2^31 or more is an error, as scores would exceed 64 bits; empty tables give no rows; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import appended, named_path, table, written

C = F.col
RING = 1024
#: Numbers in the sample that pivots are fitted on; pivots at most.
SAMPLE_VALUES, PIVOTS = 1 << 19, 64
#: Numbers in a batch of queries, and bytes of annuli that a task holds at once.
QUERY_VALUES, HELD = 1 << 22, 32 << 20
SALTS = 64


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): distinct usable rows with components floor(scale * x)."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(C(vec_id).cast("long").alias("vec_id"), C(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(fine)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("v")).distinct()


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors with their k + 1 smallest ids; salted first, as one vector may hold a third of all rows."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    for by in (["v", salt], ["v"]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(C("_r") <= k + 1).drop("_r")
    return rows.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _lengthened(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def fit_pivots(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of ``x``, begun from points far from each other."""
    at, far = [0], None
    for _ in range(min(count, len(x)) - 1):
        d = _distances(x, x[at[-1]][None])[:, 0]
        far = d if far is None else np.minimum(far, d)
        at.append(int(far.argmax()))
    pivots = x[at].copy()
    for _ in range(rounds):
        own = _distances(x, pivots).argmin(1)
        for j in np.unique(own):
            pivots[j] = x[own == j].mean(0)
    return pivots


ANNULI = "pivot int, lo double, hi double, n int, x binary, cuts binary, ids binary"
_ANNULI = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("x", pa.binary()), ("cuts", pa.binary()), ("ids", pa.binary())])


def _keyed(pivots: np.ndarray, most: float, dim: int):
    """Adds pivot and distance; the vector as 32-bit numbers."""

    def run(batches):
        for b in batches:
            x = _matrix(b["v"].to_pylist(), dim)
            d = _distances(_lengthened(x, most), pivots)
            own = d.argmin(1)
            raw = [r.tobytes() for r in x.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), pa.array(raw, pa.binary()), b["ids"]], ["pivot", "dist", "x", "ids"])

    return run


def _annuli(batches):
    """Rows sorted by pivot and distance, cut into annuli."""
    held = []

    def row():
        ids = [np.asarray(h[3], np.int64) for h in held]
        cuts = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        one = {"pivot": held[0][0], "lo": held[0][1], "hi": held[-1][1], "n": len(held), "x": b"".join(h[2] for h in held), "cuts": cuts.tobytes(), "ids": np.concatenate(ids).tobytes()}
        return pa.RecordBatch.from_pylist([one], schema=_ANNULI)

    for b in batches:
        for r in zip(*(b[c].to_pylist() for c in ("pivot", "dist", "x", "ids"))):
            if held and (held[0][0] != r[0] or len(held) == RING):
                yield row()
                held = []
            held.append(r)
    if held:
        yield row()


class Index:
    """The stored annuli with what searches need: pivots, the greatest squared norm, components."""

    def __init__(self, annuli: DataFrame, pivots: np.ndarray, most: float, dim: int):
        self.annuli, self.pivots, self.most, self.dim = annuli, pivots, most, dim


def build_index(rows: DataFrame, k: int, pivots: int = PIVOTS) -> Index | None:
    """The index of ``rows`` (vec_id, v); None if there are none."""
    classes = written(_classes(rows, k), "classes")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most, dim = classes.agg(F.count("*"), F.max(norm2), F.max(F.size("v"))).first()
    if not n:
        return None
    if most >= 2.0**62:
        raise ValueError("vectors with a norm of 2^31 or more would have scores beyond 64 bits")
    some = classes.select("v").orderBy(F.xxhash64("v")).limit(max(1, SAMPLE_VALUES // max(1, dim))).collect()
    centres = fit_pivots(_lengthened(_matrix([r["v"] for r in some], dim), most), max(1, min(pivots, n // 64)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n * max(1, dim) // (QUERY_VALUES // 2)), min(2 * cores, n // RING))
    keyed = classes.mapInArrow(_keyed(centres, most, dim), "pivot int, dist double, x binary, ids array<bigint>")
    ordered = keyed.repartitionByRange(parts, "pivot", "dist").sortWithinPartitions("pivot", "dist")
    return Index(written(ordered.mapInArrow(_annuli, ANNULI), "annuli"), centres, most, dim)


class _Best:
    """The k best (score, vec_id) of each query so far, as sorted rows."""

    def __init__(self, ids: np.ndarray, k: int, bound: np.ndarray):
        self.ids, self.k, self.bound = ids, k, bound.copy()
        self.q, self.s, self.v = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        fresh = v != self.ids[q]
        q, s, v = (np.concatenate((a, b[fresh])) for a, b in ((self.q, q), (self.s, s), (self.v, v)))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], s[last])
        keep = (rank < self.k) & (s >= self.bound[q])
        self.q, self.s, self.v = q[keep], s[keep], v[keep]


#: No score is below this.
NONE = -(1 << 62)
FOUND = "q long, query_id long, vec_id long, score long"


def _search(pivots: np.ndarray, most: float, dim: int, batch, k: int, home: bool):
    """The task of a search: queries against the annuli of a partition; with ``home`` each only against the annuli that its own key falls in."""
    exact = most < 2.0**52  # then products of doubles are whole numbers

    def run(batches):
        ids, x, bound = batch.value
        far = _distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], 1), pivots)
        own, norm2 = far.argmin(1), (x.astype(np.float64) ** 2).sum(1)
        xs = x.astype(np.float64) if exact else x.astype(np.int64)
        slack = 1e-6 * (1 + most**0.5)
        best = _Best(ids, k, bound)

        def radius():
            r2 = norm2 + most - 2 * best.bound.astype(np.float64)
            return np.where(best.bound == NONE, np.inf, np.sqrt(np.maximum(r2, 0)) + slack)

        def visit(q: np.ndarray, ring: dict) -> None:
            v = np.frombuffer(ring["x"], np.int32).reshape(ring["n"], dim)
            cuts, own_ids = np.frombuffer(ring["cuts"], np.int64), np.frombuffer(ring["ids"], np.int64)
            step = max(1, (4 << 20) // max(1, len(v)))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                s = (xs[part] @ v.T.astype(xs.dtype)).astype(np.int64)
                low = best.bound[part]
                if len(v) > k + 1:  # the k + 1 best vectors hold the k best candidates, but for ties with the last
                    low = np.maximum(low, np.partition(s, len(v) - k - 1, axis=1)[:, len(v) - k - 1])
                r, c = np.nonzero(s >= low[:, None])
                size = cuts[c + 1] - cuts[c]
                who = own_ids[np.repeat(cuts[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                best.add(part[np.repeat(r, size)], np.repeat(s[r, c], size), who)

        def expand(rings: list[dict]) -> None:
            at = np.array([r["pivot"] for r in rings])
            lo, hi = (np.array([r[c] for r in rings]) for c in ("lo", "hi"))
            gap = np.maximum(np.maximum(lo - far[:, at], far[:, at] - hi), 0)
            if home:
                inside = (at == own[:, None]) & (gap <= slack)
                for j in range(len(rings)):
                    if inside[:, j].any():
                        visit(np.flatnonzero(inside[:, j]), rings[j])
                return
            order = np.argsort(gap, axis=1, kind="stable")
            everyone = np.arange(len(x))
            for j in range(len(rings)):
                nearest = order[:, j]
                live = np.flatnonzero(gap[everyone, nearest] <= radius())
                if not len(live):
                    return  # gaps only grow and radii only shrink
                for ring in np.unique(nearest[live]):
                    visit(live[nearest[live] == ring], rings[ring])

        held, size = [], 0
        for b in batches:
            for ring in b.to_pylist():
                held.append(ring)
                size += len(ring["x"])
                if size >= HELD:
                    expand(held)
                    held, size = [], 0
        if held:
            expand(held)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (best.q, ids[best.q], best.v, best.s)], ["q", "query_id", "vec_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each of ``queries`` (vec_id, v), ties to the smaller vec_id."""
    spark = queries.sparkSession
    total = queries.count()
    batches = max(1, -(-total * max(1, index.dim) // QUERY_VALUES))
    dealt = written(queries.withColumn("batch", F.pmod(F.xxhash64("vec_id", "v"), F.lit(batches))), "queries")
    path = named_path(spark, "nearest")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for b in range(batches):
        rows = dealt.where(C("batch") == b).select("vec_id", "v").collect()
        if not rows:
            continue
        ids, x = np.array([r["vec_id"] for r in rows], np.int64), _matrix([r["v"] for r in rows], index.dim)
        bound = np.full(len(ids), NONE, np.int64)
        for home in (True, False):
            sent = spark.sparkContext.broadcast((ids, x, bound))
            task = _search(index.pivots, index.most, index.dim, sent, k, home)
            found = index.annuli.mapInArrow(task, FOUND).withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)
            if home:
                for q, s in found.where(C("rank") == k).select("q", "score").collect():
                    bound[q] = s
            else:
                out = appended(found.select("query_id", "rank", "vec_id", "score"), path)
            sent.unpersist()
    return out


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    index, queries = build_index(rows, 5), rows.where("vec_id % 50 = 0")
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(index, queries, 5)


OP12_SQL = """
WITH rows AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

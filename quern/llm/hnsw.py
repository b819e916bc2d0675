"""Approximate nearest neighbours: one navigable small-world hierarchy per shard.

Equal vectors collapse to one node that keeps its k + 1 smallest ids. Nodes are dealt by hash to shards
of at most about SHARD, so that an index fits a worker; each shard's hierarchy is stored as flat
neighbour arrays in the shared folder. Nodes are numbered by falling level, so that a layer is a prefix of them and
holds arrays for its own nodes only. A node links to diverse ones among the CANDIDATES nearest of the nodes before it, found by a search of
the hierarchy built so far (by products within its block and while a layer is small). When a shard is built, PROBES of its own nodes are searched and compared with brute force within the shard;
the width of searches doubles until they find RECALL of the nearest, and is stored with the index. Every query goes to every shard: an index is read once and the blocks of queries stream past
it; shard results are merged, and nodes expand to their ids.

Nearness is the inner product. The graph is built on vectors lengthened by
one coordinate to equal norms, which keeps that order for any norms. Scores are in double precision on
the original vectors. Vectors null, empty, zero or with null or non-finite components take no part;
vectors of different lengths never meet. Repeated query rows are one query. Rows that share the query's id are not
its candidates; rows that repeat another id count separately. Empty tables give no rows; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table, written

SHARD = 1 << 16
#: Small tables are dealt to the cluster's cores as long as shards keep so many nodes.
LEAST = 4096
#: Bytes for the marks of visited nodes in one search.
MARKS = 1 << 26
DEGREE = 16
#: Candidates of a new node, links kept open while it is inserted, and nodes up to which a layer is linked by products.
CANDIDATES, OPEN, SMALL = 64, 96, 16384
#: Links kept open in a query's search: SEARCH at least, doubled until PROBES nodes of the shard find RECALL of their nearest.
SEARCH, PROBES, RECALL = 128, 128, 0.95
WIDTH = 16
BLOCK = 1024


def search(q: np.ndarray, x: np.ndarray, near: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; (ids, similarities), best first, -1 where none."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    ids = np.full((b, ef), -1, np.int64)
    sim = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    e = entry[:, :ef]
    s = np.where(e >= 0, np.einsum("bmd,bd->bm", x[e], q), -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    w = e.shape[1]
    ids[:, :w], sim[:, :w] = np.take_along_axis(e, order, 1), np.take_along_axis(s, order, 1)
    done[:, :w] = ids[:, :w] < 0
    seen[np.repeat(np.arange(b), w)[(e >= 0).ravel()], e[e >= 0]] = True
    live = np.arange(b)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        take = open_ & (rank <= WIDTH)
        live = live[open_.any(1)]
        take = take[open_.any(1)]
        if not len(live):
            break
        at = np.argsort(~take, axis=1, kind="stable")[:, :WIDTH]
        ok = np.take_along_axis(take, at, 1)
        done[live[:, None], at] |= ok
        nb = np.where(ok[:, :, None], near[np.where(ok, ids[live[:, None], at], 0)], -1).reshape(len(live), -1)
        nb = np.sort(nb, axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        nb[(nb >= 0) & seen[live[:, None], np.maximum(nb, 0)]] = -1
        r, c = np.nonzero(nb >= 0)
        seen[live[r], nb[r, c]] = True
        s = (x[np.maximum(nb, 0)] @ q[live][:, :, None])[:, :, 0]
        s[nb < 0] = -np.inf
        all_s = np.concatenate([sim[live], s], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
        sim[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nb], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], nb < 0], 1), top, 1)
    return ids, sim


def _diverse(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Per row up to ``degree`` of the candidates: first those nearer to the node than to any chosen one."""
    b, m = ids.shape
    ids, sim = ids[:, : 3 * degree], sim[:, : 3 * degree]
    m = ids.shape[1]
    own = x[ids]
    cross = own @ own.transpose(0, 2, 1)
    keep = np.zeros((b, m), bool)
    for j in range(m):
        near = (cross[:, j, :] > sim[:, j, None]) & keep
        keep[:, j] = (ids[:, j] >= 0) & ~near.any(1) & (keep.sum(1) < degree)
    rank = np.where(ids < 0, 2, np.where(keep, 0, 1)) * m + np.arange(m)
    at = np.argsort(rank, axis=1)[:, :degree]
    return np.take_along_axis(ids, at, 1)


def build_layer(x: np.ndarray, n: int, degree: int, above: list[np.ndarray] = ()) -> np.ndarray:
    """Neighbour array (n, degree) of the first ``n`` rows, inserted in order in blocks; ``above`` are the layers over it."""
    near = np.full((n, degree), -1, np.int32)
    small = max(SMALL, len(above[-1]) if above else 0)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        base = 0 if a < small else a
        sim = x[a:b] @ x[base:b].T
        sim[np.arange(a, b)[:, None] <= np.arange(base, b)[None, :]] = -np.inf  # only nodes before
        m = min(CANDIDATES, b - base)
        ids = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m < b - base else np.broadcast_to(np.arange(b - base), sim.shape)
        s = np.take_along_axis(sim, ids, 1)
        ids = ids + base
        if base:
            old, old_s = search(x[a:b], x[:a], near[:a], enter(x[a:b], x, above), OPEN)
            ids, s = np.concatenate([old[:, :CANDIDATES], ids], 1), np.concatenate([old_s[:, :CANDIDATES], s], 1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :CANDIDATES]
        ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        ids = np.where(np.isfinite(s), ids, -1)
        mine = _diverse(x, ids, s, degree // 2)
        near[a:b, : mine.shape[1]] = mine
        r, c = np.nonzero(mine >= 0)
        _link(x, near, mine[r, c], a + r)
    return near


def enter(q: np.ndarray, x: np.ndarray, above: list[np.ndarray]) -> np.ndarray:
    """Where searches of the next layer begin: the best nodes found from the top down."""
    entry = np.zeros((len(q), 1), np.int64)
    for near in above:
        entry = search(q, x[: len(near)], near, entry, 16)[0][:, :8]
    return entry


def _link(x: np.ndarray, near: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Add the links src -> dst; nodes without room keep diverse ones of all they have."""
    o = np.argsort(src, kind="stable")
    src, dst = src[o], dst[o]
    who, first, count = np.unique(src, return_index=True, return_counts=True)
    place = np.arange(len(src)) - np.repeat(first, count)
    degree = near.shape[1]
    have = (near[who] >= 0).sum(1)
    room = have + count <= degree
    put = np.repeat(room, count)
    near[src[put], (np.repeat(have, count) + place)[put]] = dst[put]
    for k in range(int(count[~room].max(initial=0)).bit_length()):  # nodes with like numbers of new links together
        full = np.flatnonzero(~room & (count >= 1 << k) & (count < 2 << k))
        for part in np.array_split(full, max(1, len(full) * (degree + (2 << k)) // (1 << 18))):
            if not len(part):
                continue
            wide = np.full((len(part), degree + (2 << k)), -1, np.int64)
            wide[:, :degree] = near[who[part]]
            for i, j in enumerate(part):
                wide[i, degree : degree + count[j]] = dst[first[j] : first[j] + count[j]]
            s = np.where(wide >= 0, np.einsum("umd,ud->um", x[wide], x[who[part]]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            near[who[part]] = _diverse(x, np.take_along_axis(wide, order, 1), np.take_along_axis(s, order, 1), degree)


def lengthened(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all rows have the largest norm."""
    n = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(n.max() - n, 0))[:, None]], 1).astype(np.float32) / np.float32(max(np.sqrt(n.max()), 1e-30))


class Index:
    """Layers from the top down; ``near[k]`` holds the neighbour arrays of the layer's nodes, a prefix of all."""

    def __init__(self, vectors: np.ndarray, near: list[np.ndarray] | None = None, width: int = SEARCH):
        """``vectors`` must be in an order that has nothing to do with them, as ``level_sizes`` deals levels by place."""
        self.x, self.width = lengthened(vectors), width
        if near is not None:
            self.near = near
            return
        self.near = []
        for n in level_sizes(len(vectors)):
            self.near.append(build_layer(self.x, n, 2 * DEGREE, self.near))

    def query(self, q: np.ndarray, k: int) -> np.ndarray:
        q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        return search(q, self.x, self.near[-1], enter(q, self.x, self.near[:-1]), max(self.width, 2 * k))[0][:, :k]

    def widen(self, k: int) -> None:
        """Double the width of searches until probes among the nodes find RECALL of their k nearest."""
        n = len(self.x)
        # Nodes of the bottom layer come last; each asks as a query does, without its added coordinate.
        q = self.x[max(0, n - PROBES) :, :-1]
        sim = q @ self.x[:, :-1].T
        m = min(k, n)
        best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        while self.width < n:
            got = self.query(q, k)
            if np.mean([len(np.intersect1d(a, b)) for a, b in zip(got, best)]) >= RECALL * m:
                break
            self.width *= 2


def level_sizes(n: int) -> list[int]:
    """Nodes of each layer from the top: every layer has a DEGREE-th of the one below."""
    out = [n]
    while out[0] > 2 * DEGREE:
        out.insert(0, -(-out[0] // DEGREE))
    return out


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


INDEX = "dim int, shard int, n int, width int, x binary, near binary, size binary, ids binary"


def _batches(frames, keys: list[str]):
    """The rows of each group of neighbouring equal keys, whole."""
    kept, now = [], None
    for b in frames:
        for key, part in b.groupby(keys, sort=False):
            if now is not None and key != now:
                yield now, pd.concat(kept)
                kept = []
            now = key
            kept.append(part)
    if kept:
        yield now, pd.concat(kept)


def build_index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Stored index, one row per shard and length of vectors (flat vectors, neighbour arrays and the ids behind each node), and the number of shards."""
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    nodes = written(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    n = nodes.count()
    shards = max(1, -(-n // SHARD), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    keyed = nodes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("v", F.lit(5)).alias("h"))

    def build(frames):
        for (dim, shard), b in _batches(frames, ["dim", "shard"]):
            x = np.stack(b["v"].to_list())
            index = Index(x)
            index.widen(k + 1)
            size = np.array([len(i) for i in b["ids"]], np.int32)
            ids = np.concatenate([np.asarray(i, np.int64) for i in b["ids"]])
            near = b"".join(a.tobytes() for a in index.near)
            yield pd.DataFrame([(dim, shard, len(x), index.width, x.tobytes(), near, size.tobytes(), ids.tobytes())], columns=[f.split(" ")[0] for f in INDEX.split(", ")])

    # A partition holds one shard, its rows ordered by a hash, which deals the levels.
    dealt = keyed.repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", "h")
    return written(dealt.mapInPandas(build, INDEX), "index"), shards


def _load(row) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    """Index, original vectors, ids, and where each node's ids start."""
    x = np.frombuffer(row.x, np.float64).reshape(row.n, row.dim)
    flat, near, at = np.frombuffer(row.near, np.int32), [], 0
    for n in level_sizes(row.n):
        near.append(flat[at : at + n * 2 * DEGREE].reshape(n, -1))
        at += n * 2 * DEGREE
    return Index(x, near, row.width), x, np.frombuffer(row.ids, np.int64), np.concatenate(([0], np.cumsum(np.frombuffer(row.size, np.int32))))


def _best(loaded, qid: np.ndarray, q: np.ndarray, k: int):
    """(place of the query, vec_id, score) of the k best ids for each query in one shard."""
    index, x, ids, cut = loaded
    got = index.query(q, k + 1)
    r, c = np.nonzero(got >= 0)
    node = got[r, c]
    score = (x[node] * q[r]).sum(1)
    size = cut[node + 1] - cut[node]
    who = ids[np.repeat(cut[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    r, score = np.repeat(r, size), np.repeat(score, size)
    ok = who != qid[r]
    r, who, score = r[ok], who[ok], score[ok]
    order = np.lexsort((who, -score, r))
    r, who, score = r[order], who[order], score[order]
    ok = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[ok], who[ok], score[ok]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of ``rows`` for each of ``queries``, both from ``usable``."""
    index, shards = build_index(rows, k)
    # Numbers are never null here, so that pandas keeps them whole.
    blank = {"x": "binary", "near": "binary", "size": "binary", "ids": "binary"}
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    q = queries.distinct().select(F.size("v").alias("dim"), F.lit(1).alias("seq"), "vec_id", "v", F.xxhash64("v").alias("h"), each).withColumns({"n": F.lit(0), "width": F.lit(0)})
    q = q.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()})
    first = index.withColumns({"seq": F.lit(0), "vec_id": F.lit(0).cast("long"), "v": F.lit(None).cast("array<double>"), "h": F.lit(0).cast("long")})
    # In each partition an index comes first and its queries stream past it.
    stream = first.unionByName(q).repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", "seq")

    def ask(frames):
        at, loaded = None, None
        for b in frames:
            for (dim, shard), part in b.groupby(["dim", "shard"], sort=False):
                for row in part[part["seq"] == 0].itertuples(index=False):
                    at, loaded = (dim, shard), _load(row)
                part = part[part["seq"] == 1]
                if at != (dim, shard) or not len(part):  # no vector of this length in the shard
                    continue
                qid, h, v = part["vec_id"].to_numpy(np.int64), part["h"].to_numpy(np.int64), np.stack(part["v"].to_list())
                step = max(1, min(512, MARKS // len(loaded[1])))
                for a in range(0, len(qid), step):
                    r, who, score = _best(loaded, qid[a : a + step], v[a : a + step], k)
                    yield pd.DataFrame({"query_id": qid[a + r], "h": h[a + r], "vec_id": who, "score": score})

    found = stream.mapInPandas(ask, "query_id long, h long, vec_id long, score double")
    w = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where("vec_id % 20 = 0"))

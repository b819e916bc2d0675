"""Graphs stored as blocks of compressed rows, and walks that finish each block before anything is exchanged.

A block is a run of at most BLOCK edges in the order of (src, dst): its sources, their degrees, targets and weights as flat arrays in one row. The edges of
a hub go over as many blocks as they need. A walk settles a block to its own fixpoint with a priority queue; only distances of
nodes beyond the block, and of sources that other blocks share, are sent on. A path thus costs a round for each block border that it crosses and not for each step, and
there is no limit on rounds. The driver holds each block's first and last source.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.tables import BROADCAST_KEYS, named_path, written

C = F.col
BLOCK = 1 << 18
#: A row has several MB. Parquet looks at its buffers every hundred rows only, and readers take a whole row group at once, so groups have few rows.
FILES = {"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
ROWS = "block long, first long, last long, m int, src binary, degree binary, dst binary, weight binary"
_ROWS = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("m", pa.int32()), ("src", pa.binary()), ("degree", pa.binary()), ("dst", pa.binary()), ("weight", pa.binary())])


@dataclass
class Blocks:
    """The stored rows with the directory of their borders."""

    rows: DataFrame
    no: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def degrees(self) -> DataFrame:
        """(node, degree) of every source."""
        each = self.rows.select("src", "degree").mapInArrow(_degrees, "node long, degree long")
        return each.groupBy("node").agg(F.sum("degree").alias("degree"))

    def edges(self) -> DataFrame:
        """(src, dst, weight) of every edge."""
        return self.rows.mapInArrow(_edges, "src long, dst long, weight long")


def _one(batches):
    """Row by row: a batch of blocks is never held a second time as Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _degrees(batches):
    for r in _one(batches):
        src, degree = r["src"], r["degree"]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(src, np.int64)), pa.array(np.frombuffer(degree, np.int32).astype(np.int64))], ["node", "degree"])


def _edges(batches):
    for r in _one(batches):
        src = np.repeat(np.frombuffer(r["src"], np.int64), np.frombuffer(r["degree"], np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(src), *(pa.array(np.frombuffer(r[c], np.int64)) for c in ("dst", "weight"))], ["src", "dst", "weight"])


def store(edges: DataFrame, block: int = BLOCK) -> Blocks:
    """``edges`` (src, dst[, weight]) as blocks; edges without weight weigh 1, repeats are kept."""
    weight = C("weight").cast("long") if "weight" in edges.columns else F.lit(1).cast("long")

    def cut(batches):
        from pyspark import TaskContext

        no, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row(e):
            src, degree = np.unique(e[0], return_counts=True)
            one = {"block": no, "first": int(src[0]), "last": int(src[-1]), "m": len(e[0]), "src": src.tobytes(), "degree": degree.astype(np.int32).tobytes(), "dst": e[1].tobytes(), "weight": e[2].tobytes()}
            return pa.RecordBatch.from_pylist([one], schema=_ROWS)

        for b in batches:
            held.append(np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight")]))
            size += b.num_rows
            while size >= block:
                e = np.concatenate(held, axis=1)
                yield row(e[:, :block].copy())
                no, held, size = no + 1, [e[:, block:]], size - block
        if size:
            yield row(np.concatenate(held, axis=1))

    e = edges.select(C("src").cast("long").alias("src"), C("dst").cast("long").alias("dst"), weight.alias("weight"))
    rows = written(e.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(cut, ROWS), "blocks", **FILES)
    ends = rows.select("block", "first", "last").orderBy("block").collect()
    no, first, last = (np.array([r[c] for r in ends], np.int64) for c in ("block", "first", "last"))
    if (first[1:] < last[:-1]).any():
        raise RuntimeError("the blocks are not in the order of their sources")
    return Blocks(rows, no, first, last)


def settle(src: list, offset: list, dst: list, weight: list, best: list, given: dict, shared: set) -> tuple[dict, int, int]:
    """Bring a block to its fixpoint from the nodes whose distances fell: what goes to others, edges relaxed and nodes visited. ``best`` is changed in place."""
    place = {v: i for i, v in enumerate(src)}
    heap, sent, relaxed, visits = [], {}, 0, 0
    for v, d in given.items():
        i = place.get(v)
        if i is not None and d < best[i]:
            best[i] = d
            heap.append((d, i))
            if v in shared:
                sent[v] = d
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        a, b = offset[i], offset[i + 1]
        relaxed, visits = relaxed + b - a, visits + 1
        for k in range(a, b):
            to, new = dst[k], d + weight[k]
            j = place.get(to)
            if j is None:
                if new < sent.get(to, new + 1):
                    sent[to] = new
            elif new < best[j]:
                best[j] = new
                heapq.heappush(heap, (new, j))
                if to in shared:
                    sent[to] = new
    return sent, relaxed, visits


FAR = 1 << 62
_SENT = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("best", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("blocks", "nodes", "distances")), ("relaxed", pa.int64()), ("visits", pa.int64())])
_OUT = "block long, round int, best binary, blocks array<long>, nodes array<long>, distances array<long>, relaxed long, visits long"


def distances(blocks: Blocks, source: int, run=None, max_rounds: int | None = None) -> DataFrame:
    """(node, distance) of all nodes that paths from ``source`` reach, over non-negative whole weights. ``run`` takes notes of what was done."""
    spark = blocks.rows.sparkSession
    no, first, last = blocks.no, blocks.first, blocks.last
    twice = set(first[1:][first[1:] == last[:-1]].tolist())  # sources whose edges go over several blocks

    def routed(nodes: np.ndarray, far: np.ndarray) -> tuple[list, list, list]:
        """Every message once for each block that may hold its node; block -1 where none does."""
        low, high = np.searchsorted(last, nodes, "left"), np.searchsorted(first, nodes, "right") - 1
        n = np.maximum(high - low + 1, 1)
        at = np.repeat(np.arange(len(nodes)), n)
        k = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        known = (low <= high)[at]
        to = np.where(known, no[np.where(known, k, 0)], -1) if len(no) else np.full(len(at), -1)
        return to.tolist(), nodes[at].tolist(), far[at].tolist()

    def walk(round_: int):
        def go(batches):
            for r in _one(batches):
                src = np.frombuffer(r["src"], np.int64)
                best = np.frombuffer(r["best"], np.int64).tolist() if r["best"] else [FAR] * len(src)
                offset = np.concatenate(([0], np.cumsum(np.frombuffer(r["degree"], np.int32)))).tolist()
                names = src.tolist()
                given = dict(zip((m["node"] for m in r["given"]), (m["distance"] for m in r["given"])))
                shared = twice & {names[0], names[-1]}
                sent, relaxed, visits = settle(names, offset, np.frombuffer(r["dst"], np.int64).tolist(), np.frombuffer(r["weight"], np.int64).tolist(), best, given, shared)
                to, nodes, far = routed(np.array(list(sent), np.int64), np.array(list(sent.values()), np.int64))
                own = {t for t in sent if t in shared}
                keep = [i for i, t in enumerate(to) if t != r["block"] or nodes[i] not in own]  # a node that is no source is told all the same
                out = {"block": r["block"], "round": round_, "best": np.array(best, np.int64).tobytes(), "relaxed": relaxed, "visits": visits}
                out |= {"blocks": [to[i] if to[i] != r["block"] else -1 for i in keep], "nodes": [nodes[i] for i in keep], "distances": [far[i] for i in keep]}
                yield pa.RecordBatch.from_pylist([out], schema=_SENT)

        return go

    path, latest, round_ = named_path(spark, "walk"), {}, 0
    to, nodes, far = routed(np.array([source]), np.array([0]))
    begin = spark.createDataFrame([(-1, 0, None, to, nodes, far, 0, 0)], _OUT)
    begin.write.partitionBy("round").parquet(path)
    log = spark.read.schema(begin.schema).option("basePath", path)
    while True:
        # Only the last round's folder is read for messages, and of states only the rounds that hold the latest ones.
        told = log.parquet(f"{path}/round={round_}").where("size(nodes) > 0").select(F.explode(F.arrays_zip("blocks", "nodes", "distances")).alias("m")).where("m.blocks >= 0")
        pending = told.groupBy(C("m.blocks").alias("block"), C("m.nodes").alias("node")).agg(F.min("m.distances").alias("distance"))
        given = written(pending.groupBy("block").agg(F.collect_list(F.struct("node", "distance")).alias("given")), "given")
        active = {r["block"]: r["n"] for r in given.select("block", F.size("given").alias("n")).collect()}  # a row for each block at most
        if not active:
            break
        round_ += 1
        if max_rounds and round_ > max_rounds:
            raise RuntimeError(f"the walk did not end in {max_rounds} rounds")
        small = sum(active.values()) <= BROADCAST_KEYS
        state = spark.createDataFrame([(b, latest[b]) for b in active if b in latest], "block long, round int")
        state = log.parquet(path).where(C("round").isin(sorted({latest[b] for b in active if b in latest}) or [-1])).join(F.broadcast(state), ["block", "round"]).select("block", "best")
        now = blocks.rows.where(C("block").isin(list(active))) if len(active) <= 1000 else blocks.rows
        now = now.join(F.broadcast(given) if small else given, "block").join(state, "block", "left")
        now.mapInArrow(walk(round_), _OUT).write.options(**FILES).mode("append").partitionBy("round").parquet(path)
        latest |= dict.fromkeys(active, round_)
        if run:
            run.iterations, run.max_frontier = round_, max(run.max_frontier, sum(active.values()))
    whole = log.parquet(path)
    if run:
        run.converged = True
        run.edge_iterations, run.active_visits = whole.agg(F.sum("relaxed"), F.sum("visits")).first()

    def states(batches):
        for r in _one(batches):
            d = np.frombuffer(r["best"], np.int64)
            ok = d < FAR
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["src"], np.int64)[ok]), pa.array(d[ok])], ["node", "distance"])

    last_rounds = F.broadcast(spark.createDataFrame(list(latest.items()), "block long, round int"))
    held = blocks.rows.select("block", "src").join(whole.join(last_rounds, ["block", "round"]).select("block", "best"), "block").select("src", "best")
    sent = whole.where("size(nodes) > 0").select(F.explode(F.arrays_zip("nodes", "distances")).alias("m")).select(C("m.nodes").alias("node"), C("m.distances").alias("distance"))
    return held.mapInArrow(states, "node long, distance long").union(sent).groupBy("node").agg(F.min("distance").alias("distance"))

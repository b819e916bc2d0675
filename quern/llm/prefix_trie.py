"""Prefix trie of conversations, built as a Patricia tree over sorted sequences of turns.

A conversation is the sequence of its turns' 128-bit digests. Sequences are sorted by ranges; a sorted run becomes chunks of bounded bytes, each one
row. Chunks are walked with a stack that makes only branch, end and leaf points. A point that reaches beyond its chunk (the *spine*: prefixes
that the next or previous chunk shares) is made in every chunk that it crosses, as the chunks' borders tell, and its parts are merged by key; all other points are
finished within their chunk. Sums over subtrees run on the compressed tree; the unary nodes of an edge follow from sums along it.

Texts are never gathered: a conversation is 16 bytes and one number a turn, and must fit a task as such. The driver sees each chunk's
first and last sequence and two lists of depths, no more. Copies of a sequence count in runs, so a third of all conversations may be equal.

Odd input: rows without conv_id belong to no conversation; null turns come first, null roles and texts are empty; repeated turn numbers are ordered by
their digest, and repeated rows are turns of their own; an empty table has no nodes; extra columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import split_join, table, written

C = F.col
#: Bytes of a turn's digest.
STEP = 16
#: Bytes of sequences and ids that one chunk holds at most, but for its last sequence.
CHUNK = 8 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as structs of digest (hexadecimal) and code points."""
    role, text = (F.coalesce(C(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * STEP)
    turn = F.struct(C("turn").isNotNull().alias("has"), C("turn").alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = conversations.where("conv_id is not null").select(C("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    seq = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(seq.alias("seq"))


def rebuilt(sequences: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """``sequences`` whose first h turns come from the conversation that opens their group, with h = crc32(conv_id) % heads."""
    first = sequences.where(C("conv_id") % group == 0).select(C("conv_id").alias("_base"), F.slice("seq", 1, heads - 1).alias("_first"))
    both = sequences.withColumn("_base", C("conv_id") - C("conv_id") % group).join(first, "_base", "left")
    h = (F.crc32(C("conv_id").cast("string")) % heads).cast("int")
    head = F.slice(F.coalesce("_first", F.slice("seq", 1, F.lit(0))), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.slice("seq", h + 1, F.size("seq"))).alias("seq"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from their start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[STEP * low : STEP * middle] == b[STEP * low : STEP * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _falls(depths) -> list[int]:
    """The distinct running minima of ``depths``."""
    out: list[int] = []
    for d in depths:
        if not out or d < out[-1]:
            out.append(d)
    return out


CHUNKS = "no long, keys array<binary>, n array<long>, low array<long>, chars array<array<int>>, ends array<string>, first_ids binary, last_ids binary, first_key binary, last_key binary, left array<int>, right array<int>"
_CHUNKS = pa.schema([
    ("no", pa.int64()), ("keys", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("chars", pa.list_(pa.list_(pa.int32()))), ("ends", pa.list_(pa.string())),
    ("first_ids", pa.binary()), ("last_ids", pa.binary()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
])


def _chunks(batches, limit: int):
    """Sorted (key, conv_id, chars) as chunks; a sequence is [key, ids, chars] with its ids ascending."""
    from pyspark import TaskContext

    no = TaskContext.get().partitionId() << 32
    runs, size = [], 0

    def row():
        keys, ids = [r[0] for r in runs], [b",".join(r[1]) for r in runs]
        near = [_shared(a, b) for a, b in zip(keys, keys[1:])]
        one = {
            "no": no, "keys": keys, "n": [len(r[1]) for r in runs], "low": [int(r[1][0]) for r in runs], "chars": [r[2] for r in runs],
            "ends": [hashlib.sha256(x).hexdigest() for x in ids], "first_ids": ids[0], "last_ids": ids[-1],
            "first_key": keys[0], "last_key": keys[-1], "left": _falls(near), "right": _falls(near[::-1]),
        }
        return pa.RecordBatch.from_pylist([one], schema=_CHUNKS)

    for b in batches:
        for key, conv, chars in zip(b["key"].to_pylist(), b["conv_id"].to_pylist(), b["chars"].to_pylist()):
            if size > limit:
                yield row()
                runs, size, no = [], 0, no + 1
            name = str(conv).encode()
            if runs and runs[-1][0] == key:
                runs[-1][1].append(name)
            else:
                runs.append([key, [name], chars])
                size += 2 * len(key) + 64
            size += len(name) + 1
    if runs:
        yield row()


def _borders(chunks: list) -> dict[int, tuple]:
    """For each chunk's number: the depths of points that its neighbours give its first and its last sequence, and the depths shared with them."""
    for a, b in zip(chunks, chunks[1:]):
        if bytes(a["last_key"]) > bytes(b["first_key"]):
            raise RuntimeError("the sorted sequences are not in the order of their partitions")
    near = [_shared(bytes(a["last_key"]), bytes(b["first_key"])) for a, b in zip(chunks, chunks[1:])]

    def gathered(order, inner: str, step: int) -> list[list[int]]:
        out, before = [], []
        for i in order:
            out.append(before)
            j = i if step > 0 else i - 1
            if 0 <= j < len(near):
                own, d = list(chunks[i][inner]), near[j]
                low = min([d, *own])
                before = [d, *(x for x in own if x < d), *(x for x in before if x < low)]
        return out

    n = len(chunks)
    left = gathered(range(n), "right", 1)
    right = gathered(range(n - 1, -1, -1), "left", -1)[::-1]
    return {c["no"]: (left[i], right[i], near[i - 1] if i else 0, near[i] if i < n - 1 else 0) for i, c in enumerate(chunks)}


class _Point:
    __slots__ = ("depth", "rep", "parent", "spine", "n", "low", "leaves", "kids", "saved", "end")

    def __init__(self, depth: int, rep: int, spine: bool):
        self.depth, self.rep, self.spine, self.parent, self.end = depth, rep, spine, None, None
        self.n = self.leaves = self.kids = self.saved = 0
        self.low = None

    def add(self, n: int, low: int | None) -> None:
        self.n += n
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)


def _walk(keys: list[bytes], ns: list[int], lows: list[int], left: list[int], right: list[int], bl: int, br: int) -> list[_Point]:
    """All points of a chunk, children before their parents; ``left`` and ``right`` are depths of points that others give."""
    root = _Point(0, 0, True)
    stack, done = [root], []
    stack += [_Point(d, 0, True) for d in sorted(left) if d]
    same = 1 << 62  # turns shared with the first sequence

    def settle(down: int, rep: int) -> None:
        """Take the top off; its parent is at depth ``down`` or deeper."""
        p = stack.pop()
        if stack[-1].depth < down:
            stack.append(_Point(down, rep, down <= bl and down <= same))
        p.parent = stack[-1]
        done.append(p)

    for i, key in enumerate(keys):
        if i:
            d = _shared(keys[i - 1], key)
            old, same = same, min(same, d)
            while stack[-1].depth > d:
                settle(d, i)
            same = min(old, d)
        depth = len(key) // STEP
        if depth > stack[-1].depth:
            stack.append(_Point(depth, i, not i and depth <= bl))
        stack[-1].end = i
        stack[-1].add(ns[i], lows[i])
    last = len(keys) - 1
    while len(stack) > 1:
        p = stack[-1]
        p.spine |= p.depth <= br
        settle(max([0, *(x for x in right if x < p.depth)]), last)
    return [*done, root]


POINTS = "spine boolean, point binary, parent binary, parent_conv long, no long, path array<int>, depth int, chars array<int>, n long, low long, kids long, leaves long, saved long, ends string, ids binary"
_POINTS = pa.schema([
    ("spine", pa.bool_()), ("point", pa.binary()), ("parent", pa.binary()), ("parent_conv", pa.int64()), ("no", pa.int64()), ("path", pa.list_(pa.int32())), ("depth", pa.int32()), ("chars", pa.list_(pa.int32())),
    ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("ids", pa.binary()),
])


def _points(borders: dict[int, tuple]):
    def run(batches):
        for b in batches:
            for c in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(rows(c)), schema=_POINTS)

    def rows(c: dict):
        keys, last = c["keys"], len(c["keys"]) - 1
        done = _walk(keys, c["n"], c["low"], *borders[c["no"]])
        for p in done:
            if p.spine:
                continue
            p.leaves = p.leaves if p.kids else 1
            up = p.parent
            p.saved += (p.n - 1) * sum(c["chars"][p.rep][up.depth : p.depth])
            up.add(p.n, p.low)
            up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + p.leaves, up.saved + p.saved
        for p in done:
            up, key = p.parent, keys[p.rep]
            one = {
                "spine": p.spine, "no": c["no"], "depth": p.depth, "chars": c["chars"][p.rep][up.depth if up else 0 : p.depth], "n": p.n, "low": p.low,
                "kids": p.kids, "leaves": p.leaves, "saved": p.saved, "parent": key[: STEP * up.depth] if up and up.spine else None,
            }
            if p.spine:
                path, at = [], p
                while at:
                    path.append(at.depth)
                    at = at.parent
                one |= {"point": key[: STEP * p.depth], "path": path}
                if p.end is not None:
                    one["ids"] = c["first_ids"] if p.end == 0 else c["last_ids"] if p.end == last else None
                    one["ends"] = c["ends"][p.end]
            else:
                one |= {"parent_conv": None if up.spine else up.low, "ends": EMPTY if p.end is None else c["ends"][p.end]}
            yield one

    return run


def _digests(batches):
    """(point, ends) of rows sorted by point and number: one digest over all pieces of a point's ids."""
    now, digest = None, None
    for b in batches:
        out = []
        for point, ids in zip(b["point"].to_pylist(), b["ids"].to_pylist()):
            if point != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = point, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["point", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["point", "ends"])


def _merged(parts: DataFrame) -> DataFrame:
    """The spine points with sums over their subtrees; few: at most the chunks times the depth of a sequence."""

    above = F.explode(F.transform("path", lambda d: F.substring(C("point"), F.lit(1), STEP * d))).alias("point")
    own = parts.groupBy("point").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max(F.struct("path", "depth", "chars", "parent")).alias("p"),
    ).select("point", "n", "low", C("kids").alias("own_kids"), "leaves", "saved", "p.*")
    own = written(own, "spine")
    more = own.where("parent is not null").groupBy(C("parent").alias("point")).agg(F.count("*").alias("more"))
    own = own.join(more, "point", "left").withColumn("kids", C("own_kids") + F.coalesce("more", F.lit(0)))
    own = own.withColumn("leaves", F.when(C("kids") == 0, 1).otherwise(C("leaves")))
    up = own.select(above, "n", "low", "leaves")
    whole = written(up.groupBy("point").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("leaves").alias("leaves")), "spine")
    own = own.select("point", "path", "depth", "chars", "parent", "own_kids", "kids", "saved").join(whole, "point")
    edge = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    own = written(own.withColumn("saved", C("saved") + (C("n") - 1) * edge), "spine")
    saved = own.select(above, "saved").groupBy("point").agg(F.sum("saved").alias("saved"))
    over = own.select(C("point").alias("parent"), C("low").alias("parent_conv"))
    return own.drop("saved").join(saved, "point").join(over, "parent", "left")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _expanded(batches):
    """Every node of each point's edge, from the top: a node saves what its point saves and its share of the edge's rest."""
    for b in batches:
        for p in b.to_pylist():
            chars = np.asarray(p["chars"], np.int64)
            k = max(1, len(chars))  # the root has no edge
            before = np.concatenate(([0], np.cumsum(chars)[:-1])) if len(chars) else np.zeros(1, np.int64)
            unary = k - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, p["low"])), pa.array(np.arange(p["depth"] - k + 1, p["depth"] + 1, dtype=np.int64)), pa.array([p["parent_conv"]] + [p["low"]] * unary, pa.int64()),
                pa.array(np.full(k, p["n"])), pa.array([1] * unary + [p["kids"]], pa.int64()), pa.array(np.full(k, p["leaves"])), pa.array(p["saved"] - (p["n"] - 1) * before),
                pa.array([EMPTY] * unary + [p["ends"]], pa.string()),
            ], [f.split(" ")[0] for f in NODES.split(", ")])


def prefix_trie(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, seq): one row for each distinct sequence of first turns, the root included.

    conv_id is the node's smallest member, depth its turns, parent_conv_id the parent's conv_id (the root has none), n_convs its members, n_children its
    children, n_leaves the childless nodes in its subtree, saved_tokens the sum over the subtree of (n_convs - 1) times the code points of a node's last
    turn, and ends_sha256 the digest of the ascending ids of the members that end here, joined by commas.
    """
    spark = sequences.sparkSession
    key = F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), ""))
    rows = sequences.select(key.alias("key"), "conv_id", F.transform("seq", lambda t: t["chars"]).alias("chars"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = written(ordered.mapInArrow(lambda b: _chunks(b, chunk), CHUNKS), "chunks")
    borders = _borders(chunks.select("no", "first_key", "last_key", "left", "right").orderBy("no").collect())
    if not borders:
        return spark.createDataFrame([], NODES)
    points = written(chunks.select("no", "keys", "n", "low", "chars", "ends", "first_ids", "last_ids").mapInArrow(_points(borders), POINTS), "points")
    spine = points.where("spine")
    top = written(_merged(spine), "spine")
    pieces = spine.where("ends is not null").select("point", "no", "ids", "ends")
    whole = pieces.where("ids is not null").select("point", "no", "ids").repartition("point").sortWithinPartitions("point", "no").select("point", "ids")
    ends = whole.mapInArrow(_digests, "point binary, ends string").union(pieces.where("ids is null").select("point", "ends"))
    columns = ("depth", "chars", "n", "low", "kids", "leaves", "saved", "ends", "parent_conv")
    upper = top.join(ends, "point", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))).select(*columns)
    inner = points.where("not spine and parent is null").select(*columns)
    below = points.where("not spine and parent is not null").drop("parent_conv")
    over = top.where("own_kids > 0").select(C("point").alias("parent"), C("low").alias("parent_conv"), C("own_kids").alias("of"))
    total = over.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    below = split_join(below, over, "parent", "of", total).select(*columns)
    return upper.unionByName(inner).unionByName(below).mapInArrow(_expanded, NODES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_sequences(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM ids, steps),
turns AS (SELECT CAST(conv_id AS BIGINT) AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS seq FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
made AS (SELECT o.c, list_concat(coalesce(b.seq[1:h], []), o.seq[h + 1:]) AS seq FROM turns o JOIN heads USING (c) LEFT JOIN turns b ON b.c = o.c - o.c % 100),
prefixes AS (SELECT c, d, len(seq) AS own, sha256(CAST(seq[1:d] AS VARCHAR)) || d AS node, CASE WHEN d > 0 THEN sha256(CAST(seq[1:d - 1] AS VARCHAR)) || (d - 1) END AS up, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS chars
  FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM made)),
nodes AS (SELECT node, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE own = d), '') AS ends FROM prefixes GROUP BY node, d),
kids AS (SELECT up AS node, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT a.node, sum((n.n - 1) * n.chars) AS saved, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.node = n.node JOIN prefixes a ON a.c = p.c AND a.d <= p.d LEFT JOIN kids k ON k.node = n.node GROUP BY a.node)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes u ON u.node = n.up
"""

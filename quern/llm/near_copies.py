"""Near copies by SimHash fingerprints, confirmed by the exact Jaccard similarity of word shingles, and an exact way for what they miss.

Two texts link if the Jaccard similarity of their shingle sets is at least 0.8. First the sets' SimHash fingerprints are linked by
pigeonring filtering, as in ``simhash``; pairs within its four bits are confirmed by their sets and make the first components. At a similarity of 0.8 fingerprints
differ in more bits than any selective key allows, so texts of different components meet once more. That way is
exact: shingles are sorted by one fixed order, rarest first, and of two sets that
similar the shorter prefixes (a fifth of each set and one) share a shingle; the first
one they share also leaves room for the overlap that 0.8 needs. Each set also has a bitmap, in which every shingle
flips one of BITS bits: two bitmaps differ in no more bits than the sets differ in shingles, which is a ninth of
both sizes at most. Every candidate left is
then confirmed by its whole sets, so no bit budget of a fingerprint loses pairs.

The order puts the commonest shingles of a hashed sixteenth of the texts last. It only saves
work: any fixed order gives the same links. Texts with equal sets collapse to one node first.

Shingles in at most PAIR_LIMIT prefixes form all pairs. Members of the others first meet in stars: each takes one of its shared shingles, another one every round, and is
compared with one member of that shingle. What groups of copies leave is little. Then, until nothing is left to do, growing numbers of members that are not in the largest
component of a shingle are compared with all its members of other components, each member once a shingle. Components, not links, are exact there. That last step is
quadratic only where a common shingle keeps many members whose sizes and bitmaps are close, and which are no near copies.

Shingles that a sample shows to be common are counted apart, by sums, so that no window gathers them; joins on them have a small side that is broadcast by its count.
Whole texts are read for candidates alone. Null texts and texts without words share one node. Sets and rows are told apart by 128 bits.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import simhash
from quern.llm.common import TYPES, arrow_batches, drop_written, merged, scratch, split_join, written
from quern.llm.components import connected_components
from quern.llm.simhash import LOWER, PAIR_LIMIT
from quern.operators.graph import forest

SHINGLE = 5
#: Links have a Jaccard similarity of at least 4/5.
NUM, DEN = 4, 5
#: One text of so many is counted to find common shingles; the commonest COMMON of them sort last.
PART, COMMON = 16, 200_000
ROUNDS = 2
#: Up to so many rows are broadcast, and so many links go to one task.
BROADCAST_KEYS = 200_000
BITS = 1024
#: Members that are compared with a whole shingle, in the first of the last rounds; eight times as many in each further one.
CENTERS = 64
#: Fingerprints whose keys one task makes; their file is so small that one task would read most of it, and a fingerprint has 35 keys or more.
PRINTS_A_TASK = 8192
#: Rows that go to Python at once; they are whole texts, or two of them a pair.
BATCH = 500
LONGS = T.ArrayType(T.LongType())
PRINT = T.StructType([T.StructField("print", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("prefix", LONGS), T.StructField("bitmap", LONGS), T.StructField("fp", T.LongType())])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - shingle + 1)].tolist()
    last = (ends[shingle - 1 :] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if NUM * max(n, m) > DEN * min(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (n + m - both)


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each of BITS places."""
    odd = np.bincount((x % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(x: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number."""
    total = sum((simhash.ones(x[k : k + simhash.BLOCK]) for k in range(0, len(x), simhash.BLOCK)), np.zeros(64, np.int64))
    return int(np.uint64(simhash.majority(total, len(x))).astype(np.int64))


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """The commonest shingles of the counted part and their counts, as two rows."""

    @F.pandas_udf(LONGS)
    def go(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts])

    part = docs.where(F.pmod(F.xxhash64(text), F.lit(PART)) == 0).select(F.explode(go(F.col(text))).alias("s"))
    found = part.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    return np.stack([found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)])  # 3 MB at most


def _prints(common):
    """Name of the set, size, prefix, bitmap and fingerprint of each text."""

    @F.pandas_udf(PRINT)
    def go(texts: pd.Series) -> pd.DataFrame:
        s, n = common.value
        by = np.argsort(s.view(np.uint64))
        keys, counts = s.view(np.uint64)[by], n[by]
        rows = []
        for t in texts:
            x = shingles(t)
            count = np.zeros(len(x), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                count = np.where(keys[at] == x, counts[at], 0)
            size = len(x) - -(-NUM * len(x) // DEN) + 1 if len(x) else 0
            rows.append((xxhash.xxh3_128_digest(x.tobytes()), len(x), x[np.lexsort((x, count))[:size]].view(np.int64), bitmap(x), fingerprint(x)))
        return pd.DataFrame(rows, columns=["print", "size", "prefix", "bitmap", "fp"])

    return go


@F.pandas_udf(TYPES["boolean"])
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    known: OrderedDict[str, np.ndarray] = OrderedDict()

    def sets(t):
        if t not in known:
            if len(known) > 200:
                known.popitem(last=False)
            known[t] = shingles(t)
        return known[t]

    return pd.Series([similar(sets(x), sets(y)) for x, y in zip(a, b)], dtype=bool)


def _room(a: str, b: str):
    """Whether sizes and places of a first shared shingle leave room for the similarity."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(x - F.col(f"{a}.at"), y - F.col(f"{b}.at"))
    return (NUM * F.greatest(x, y) <= DEN * F.least(x, y)) & ((NUM + DEN) * rest >= NUM * (x + y))


def _close(a: str, b: str):
    """Whether bitmaps leave room for the similarity: sets differ in a ninth of both sizes at most."""
    x, y = F.col(f"{a}.bitmap"), F.col(f"{b}.bitmap")
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITS // 64)), F.lit(0))
    return differ * (NUM + DEN) <= F.col(f"{a}.size") + F.col(f"{b}.size")


def _pairs(a: DataFrame, b: DataFrame, cond) -> DataFrame:
    met = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & cond & _room("a", "b"))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _spread(prints: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct fingerprints of ``prints`` in parts of some PRINTS_A_TASK."""
    return prints.select("fp").repartition(max(1, -(-n // PRINTS_A_TASK)), "fp")


def _fingerprinted(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v) that connect all nodes whose fingerprints are linked: the smallest of a fingerprint with each other, and with those of linked fingerprints."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n")), "fingerprints")
    size = prints.agg(F.count("*").alias("prints"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes")).first()
    alike = split_join(nodes.select("fp", "node"), prints, "fp", "n", size["nodes"]).select(F.col("low").alias("u"), F.col("node").alias("v"))
    met = simhash.links(_spread(prints, size["prints"]), 7 if size["prints"] < simhash.SEGMENTS_8 else 8)
    a, b = prints.select(F.col("fp").alias("u"), F.col("low").alias("x")), prints.select(F.col("fp").alias("v"), F.col("low").alias("y"))
    linked = met.join(merged(a), "u").join(merged(b), "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return alike.where("u <> v").union(linked)


def _filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps are close; two joins of a few numbers a pair save those of whole texts."""
    n = nodes.select("node", "size", "bitmap")
    a, b = n.select(F.col("node").alias("u"), F.struct("size", "bitmap").alias("a")), n.select(F.col("node").alias("v"), F.struct("size", "bitmap").alias("b"))
    return pairs.join(a, "u").join(b, "v").where(_close("a", "b")).select("u", "v")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("x"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("y"))
    return written(pairs.join(a, "u").join(b, "v").where(_similar("x", "y")).select("u", "v"), "links")


def _of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes; the smallest node itself may be missing. Few links go to one task, others meet in stars."""
    if links.count() <= BROADCAST_KEYS:
        found = forest(links.select(F.col("u").alias("src"), F.col("v").alias("dst")).coalesce(1)).toDF("node", "component")
    else:
        found = connected_components(links)
    return written(found, "components")


def _counted(every: DataFrame, common: np.ndarray) -> DataFrame:
    """``every`` (key, ...) with ``n``, the rows of the key, where there are two or more."""
    spark = every.sparkSession
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"key": common[0]}), "key long")) if common.size else None
    rare = every.join(known, "key", "left_anti") if known else every
    out = rare.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    if known:
        n = every.join(known, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(every.join(F.broadcast(n), "key"))  # no more keys than are known
    return out


def _few(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _stars(named: DataFrame, r: int) -> DataFrame:
    """Candidates of one round: every node with one member of one of its shingles."""
    one = named.groupBy("node").agg(F.min_by(F.struct("key", "size", "component", "bitmap"), F.xxhash64("key", F.lit(r))).alias("m")).select("node", "m.*")
    middle = one.groupBy("key").agg(F.min_by(F.struct("node", "size", "component", "bitmap"), F.xxhash64("node", F.lit(r))).alias("m")).select("key", "m.*")
    met = one.alias("a").join(_few(middle).alias("b"), "key").where("a.component <> b.component").where(_close("a", "b"))
    x, y = F.col("a.size"), F.col("b.size")
    met = met.where(NUM * F.greatest(x, y) <= DEN * F.least(x, y))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _open(hot: DataFrame, found: DataFrame) -> DataFrame:
    """The members of shingles that still have something to compare, by their components now.

    ``rest`` marks members that are neither done nor in the largest component of their shingle, ``left`` counts them. A shingle without any is settled for good:
    members that are done were compared with all others, the others share one component and keep sharing one.
    """
    now = hot.select("key", "node", "at", "size", "bitmap", "done").join(_few(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = written(now, "members")
    parts = now.groupBy("key", "component").agg(F.count("*").alias("c"), F.count_if(~F.col("done")).alias("undone"))
    most = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.sum("undone").alias("undone"), F.max_by("undone", F.struct("c", "component")).alias("in_most"))
    most = most.select("key", "most", (F.col("undone") - F.col("in_most")).alias("left")).where("left > 0")
    out = written(now.join(_few(written(most, "most")), "key").withColumn("rest", ~F.col("done") & (F.col("component") != F.col("most"))).drop("most"), "hot")
    drop_written(now)
    return out


def near_components(docs: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """(row, component) of every row of ``docs``; ``row`` names equal rows by 128 bits."""
    with arrow_batches(docs.sparkSession, BATCH):
        return _found(docs, row, text)


def _found(docs: DataFrame, row: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    found_common = _common(docs, text)
    common = spark.sparkContext.broadcast(found_common)
    prints = written(docs.select(F.col(row).alias("row"), _prints(common)(F.col(text)).alias("p")).select("row", "p.*"), "prints")
    one = F.min(F.struct("row", "size", "prefix", "bitmap", "fp")).alias("m")
    nodes = written(prints.groupBy("print").agg(one).select("print", "m.*").withColumn("node", F.monotonically_increasing_id()), "nodes")

    def whole(need: DataFrame) -> DataFrame:
        rows = written(nodes.select("node", "row").join(need.distinct(), "node"), "rows")
        # Equal rows share a row name; any of them has the node's set.
        texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(_few(rows), "row")
        return written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")

    with scratch(spark) as keep:
        pairs = written(_filtered(_fingerprinted(nodes), nodes), "pairs")
        links = keep(_confirmed(pairs, whole(_of(pairs))))
    own = F.coalesce("component", "node").alias("component")
    with scratch(spark) as keep:
        every = nodes.join(_few(_components(links)), "node", "left").select("node", "size", own, F.posexplode("prefix").alias("at", "key"))
        met = written(_counted(every, found_common), "keys")
        cold = met.where(F.col("n") <= PAIR_LIMIT)
        hot = met.where(F.col("n") > PAIR_LIMIT).drop("component", "n").join(nodes.select("node", "bitmap"), "node")
        hot = keep(written(hot.withColumn("done", F.lit(False)), "hot"))
        apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
        pairs = written(_filtered(_pairs(cold, cold, apart), nodes), "pairs")
        links = links.union(keep(_confirmed(pairs, whole(_of(pairs)))))
    found, texts, r, size = _components(links), None, 0, CENTERS
    while True:
        members, old = _open(hot, found), hot if r == 0 else members
        drop_written(old)
        if members.isEmpty():
            break
        # What is settled later needs no text, so those of the first round do for all; a round shuffles only those of its pairs.
        texts = texts or whole(members.select("node"))
        with scratch(spark) as keep:
            if r < ROUNDS:
                center, more = F.lit(False), _stars(members, r)
            else:
                part = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(1 << 30)) / F.lit(float(1 << 30))
                center, size = F.col("rest") & (part * F.col("left") <= size), size * 8
                few = written(members.where(center), "centers")
                more = _pairs(_few(few, BROADCAST_KEYS // 4), members, (F.col("a.component") != F.col("b.component")) & _close("a", "b"))
            more = written(more, "pairs")
            need = written(_of(more), "need")
            links = links.union(keep(_confirmed(more, texts.join(_few(need, BROADCAST_KEYS // 4), "node", "left_semi"))))
            found, r = keep(_components(links)), r + 1
            hot = members.withColumn("done", F.col("done") | center)
    return prints.select("row", "print").join(nodes.select("print", "node"), "print").join(_few(found), "node", "left").select("row", "node", F.coalesce("component", "node").alias("component"))

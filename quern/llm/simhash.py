"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits over word shingles. Two fingerprints with at most
TAU differing bits (four) link. The 64 bits form a ring of seven segments (eight from SEGMENTS_8 distinct
fingerprints on, so that keys stay selective); by the pigeonring
principle some start exists from which every chain of l segments differs
in at most floor(4 l / 7) bits. From that start the first five
segments hold at least three equal ones, in one of five layouts, so 35 keys of 28
bits find every link (eight segments: four equal ones of seven, 112 keys of 32 bits); the chain
budgets then prune candidates before the full Hamming test.

Copies collapse to one fingerprint first; links and components are those of fingerprints, so rows
without doc_id join what they lie between. A key shared by more than PAIR_LIMIT
different fingerprints never forms all pairs, which would be quadratic in a dense cluster: its fingerprints
emit the 2081 values within two bits of themselves, and two of them link exactly if they share such a
value. At most 2081 fingerprints can meet in one value, so groups stay bounded and the work
linear; components are the same.

Null texts and texts without words have fingerprint zero. Rows with a null
doc_id keep a row: their component is the smallest doc_id reachable, or null. Any type of doc_id that has an
order will do. Extra columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import TYPES, merged, split_join, table, written
from quern.llm.components import connected_components

TAU = 4
#: From so many distinct fingerprints on the ring has eight segments.
SEGMENTS_8 = 1 << 28
#: Keys with more distinct fingerprints go by midpoints instead of pairs.
PAIR_LIMIT = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def ones(h: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, the hashes that have it."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The bits that over half of ``n`` hashes have."""
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of one text: A-Z lowered, ASCII white space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate(([0], np.cumsum(size)))
    last = first[shingle : shingle + n] - 1 if len(words) >= shingle else np.array([len(joined)])
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        ends = last[k : k + BLOCK].tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first[k : k + len(ends)].tolist(), ends)), np.uint64, len(ends))
        total += ones(h)
    return majority(total, n)


def _udf(shingle: int):
    @F.pandas_udf(TYPES["long"])
    def go(texts: pd.Series) -> pd.Series:
        return pd.Series([np.uint64(fingerprint(t, shingle)).astype(np.int64) for t in texts], dtype="int64")

    return go


class Ring:
    """``m`` segments of the 64 bits, the chain budgets, and the layouts of equal segments that a viable chain has."""

    def __init__(self, m: int = 7):
        self.m = m
        self.widths = [64 // m + (i < 64 % m) for i in range(m)]
        self.starts = [sum(self.widths[:i]) for i in range(m)]
        self.budget = [TAU * (k + 1) // m for k in range(m)]
        # The shortest chain that holds the most segments that must be equal.
        sure = [k + 1 - self.budget[k] for k in range(m - 1)]
        equal, length = max(sure), sure.index(max(sure)) + 1
        self.layouts = [
            z for z in combinations(range(length), equal)
            if all(k + 1 - sum(i <= k for i in z) <= self.budget[k] for k in range(length))
        ]
        self.key_bits = equal * max(self.widths)

    def segment(self, x: Column, i: int) -> Column:
        i %= self.m
        return F.shiftrightunsigned(x, self.starts[i]).bitwiseAND((1 << self.widths[i]) - 1)

    def keys(self, fp: Column) -> Column:
        out = []
        for s in range(self.m):
            for p, layout in enumerate(self.layouts):
                key = F.lit(s * len(self.layouts) + p).cast("long")
                for i in layout:
                    key = F.shiftleft(key, max(self.widths)).bitwiseOR(self.segment(fp, s + i))
                out.append(key)
        return F.array(*out)

    def chain(self, x: Column, key: Column) -> Column:
        """Whether the chains of the ring from the key's start keep their proportional budgets."""
        d = [F.bit_count(self.segment(x, i)) for i in range(self.m)]
        viable = []
        for s in range(self.m):
            total, ok = F.lit(0), F.lit(True)
            for k in range(self.m):
                total = total + d[(s + k) % self.m]
                ok = ok & (total <= self.budget[k])
            viable.append(ok)
        start = F.floor(F.shiftrightunsigned(key, self.key_bits) / len(self.layouts))
        return F.element_at(F.array(*viable), start.cast("int") + 1)


def _masks() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = [one[i] ^ one[j] for i in range(64) for j in range(i)]
    return np.concatenate(([np.uint64(0)], one, np.array(two, np.uint64))).view(np.int64)


def _midpoints(batches):
    masks = _masks()
    for b in batches:
        for k in range(0, len(b), 256):
            fp = b["fp"].to_numpy(np.int64)[k : k + 256]
            yield pd.DataFrame({"mid": (fp[:, None] ^ masks[None, :]).ravel(), "fp": np.repeat(fp, len(masks))})


def links(nodes: DataFrame, segments: int = 7) -> DataFrame:
    """Links (u, v) of fingerprints that connect the same components as all pairs within TAU bits.

    ``nodes`` holds distinct ``fp``. Pairs under keys of at most PAIR_LIMIT
    fingerprints are all returned; under larger keys each midpoint yields a star.
    """
    ring = Ring(segments)
    keyed = nodes.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(merged(shared), "key"), "keys")
    cold = met.where(F.col("n") <= PAIR_LIMIT)
    a, b = cold.select("key", F.col("fp").alias("u")), cold.select("key", F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    pairs = a.join(merged(b), "key").where("u < v").where(ring.chain(diff, F.col("key"))).where(F.bit_count(diff) <= TAU)
    hot = met.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    star = (
        hot.mapInPandas(_midpoints, "mid long, fp long").groupBy("mid").agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    )
    return pairs.select("u", "v").union(star).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), _udf(shingle)(F.col(text)).alias("fp")), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    found = connected_components(links(nodes.select("fp"), 7 if size["nodes"] < SEGMENTS_8 else 8))
    named = nodes.join(merged(found.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "named")
    low = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    names = split_join(named, low, "component", "members", size["nodes"]).select("fp", "n", "component_id")
    return split_join(prints, written(names, "names"), "fp", "n", size["rows"]).select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

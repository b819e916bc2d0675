"""Toxicity by class-conditional Kneser-Ney bigram models.

One model per class is fitted on labelled rows outside the held-out fold. Expressions count the texts they stand in. Each model is a
distribution over the next word, in three interpolated steps with absolute discounts:

* words: in how many different contexts a word stands in the class (continuation counts), over document frequencies gathered over all documents;
* shared pairs: the pairs of both classes together, over the class's words;
* the class's pairs, over the shared pairs, which also weigh BACKOFF times their context's count, the same in both classes.

Both classes thus share their backoff counts, so that expressions rare in either class tell little.

The log-likelihood under the toxic model less that under the ordinary one is divided by the length of what it covers: the whole text, and of its passages of
PASSAGE words the most toxic one, since a toxic text may be ordinary for the most part. A logistic curve with weights of 0 or more for both, fitted on
cross-fitted ratios of the training rows, turns them into a score.

DISCOUNT, SHARED, FLOOR, BACKOFF and PASSAGE were chosen by cross-fitted AUC on training rows alone, among some thirty settings; longer passages told less (README).

Bound: at most SAMPLE distinct texts of each class, by the order of a hash of the text, are used for fitting; texts of more than SAMPLE_CHARS
characters are left out of it, not cut. No expression of the others is left
out. Every whole text is scored. Null and empty texts score the curve's value at ratio zero. Rows with a null label or
without a document do not train. Where a class has no rows, every score is the
share of toxic rows (0 without labels). Repeated rows give repeated results; an empty table gives none. Extra columns stay; one named
``_toxicity`` is replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_batches, struct, table, written

SAMPLE = 2500
SAMPLE_CHARS = 20_000
#: Whole texts that go to Python at once while a model is fitted.
BATCH = 500
THRESHOLD = 0.3
#: Below one, so that expressions of a single text keep a part of their count.
DISCOUNT = 0.98
#: Weight of the document frequencies among a class's words, as a multiple of its continuation counts.
SHARED = 0.3
#: Documents that every word counts besides those it stands in: words of few documents tell little.
FLOOR = 30
#: Weight of the shared bigrams, as a multiple of their context's count.
BACKOFF = 30
#: Words of a passage.
PASSAGE = 2
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class KneserNey:
    """log P_toxic(w | previous) - log P_ordinary(w | previous) in flat arrays."""

    def __init__(self, texts: list[list[str]], toxic: list[int], shared: dict[str, int], vocab: dict[str, int] | None = None):
        self.vocab = vocab or {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        v = self.v = len(self.vocab) + 1
        base = np.full(v, float(FLOOR))
        for w, c in shared.items():
            if w in self.vocab:
                base[self.vocab[w]] += c
        base /= base.sum()
        # Pairs count the texts they stand in, not their repeats within one text. The context of a first word is v.
        keys: list[list[np.ndarray]] = [[], []]
        for t, y in zip(texts, toxic):
            i = self.ids(t)
            if len(i):
                keys[y].append(np.unique(self.pairs(i)))
        tables = [np.unique(np.concatenate(k or [np.zeros(0, np.int64)]), return_counts=True) for k in keys]
        both = np.unique(np.concatenate([k for k, _ in tables]))
        counts = [np.zeros(len(both)) for _ in tables]
        for into, (k, c) in zip(counts, tables):
            into[np.searchsorted(both, k)] = c
        prev, word = both // v, both % v
        self.words = []
        for c in counts:
            n = np.bincount(word, weights=c > 0, minlength=v)
            kept, whole = np.maximum(n - DISCOUNT, 0), n.sum()
            self.words.append((kept + (whole - kept.sum() + SHARED * whole) * base) / (whole * (1 + SHARED)) if whole else base)

        def discounted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Counts less their discounts, and of each context the count and what was taken off."""
            return np.maximum(c - DISCOUNT, 0), np.bincount(prev, weights=c, minlength=v + 1), np.bincount(prev, weights=np.minimum(c, DISCOUNT), minlength=v + 1)

        kept, total, off = discounted(counts[0] + counts[1])
        self.known = total > 0
        total = np.where(self.known, total, 1.0)
        self.open = off / total  # what a known context leaves to the words
        back, logs, gaps, self.pair, self.rest = BACKOFF * total, [], [], [], []
        for c, u in zip(counts, self.words):
            own, mass, free = discounted(c)
            shared_pair = kept / total[prev] + self.open[prev] * u[word]
            pair = (own + (free + back)[prev] * shared_pair) / (mass + back)[prev]
            rest = (free + back) / (mass + back)
            self.pair.append(pair)
            self.rest.append(rest)
            logs.append(np.log(pair))
            gaps.append(np.where(self.known, np.log(rest), 0.0))
        self.keys = both
        self.ratio = (logs[1] - logs[0]).astype(np.float32)
        self.low = np.log(self.words[1] / self.words[0]).astype(np.float32)
        self.gap = (gaps[1] - gaps[0]).astype(np.float32)

    def probabilities(self, context: int) -> np.ndarray:
        """P(word | context) of both classes, ordinary first; words by their numbers, 0 for all unknown ones; context ``v`` for a text's start."""
        out = np.stack([(r[context] * self.open[context] if self.known[context] else 1.0) * u for r, u in zip(self.rest, self.words)])
        a, b = np.searchsorted(self.keys, [context * self.v, (context + 1) * self.v])
        out[:, self.keys[a:b] % self.v] = [p[a:b] for p in self.pair]
        return out

    def slim(self) -> KneserNey:
        """Without what only ``probabilities`` needs."""
        self.pair = self.rest = self.words = self.open = self.known = None
        return self

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate(([self.v], ids[:-1])) * self.v + ids

    def ids(self, text: list[str]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in text), np.int64, len(text))

    def features(self, text: list[str]) -> tuple[float, float]:
        """Length-normalised log-likelihood ratios of the most toxic passage and of the whole text; 0 for none."""
        if not text:
            return 0.0, 0.0
        i = self.ids(text)
        k = self.pairs(i)
        out = self.low[i] + self.gap[k // self.v]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out = np.where(self.keys[at] == k, self.ratio[at], out)
        sums = np.concatenate(([0.0], np.cumsum(out, dtype=np.float64)))
        whole = float(sums[-1] / len(out))
        if len(out) <= PASSAGE:
            return float(sums[-1] / PASSAGE), whole
        return float((sums[PASSAGE:] - sums[:-PASSAGE]).max() / PASSAGE), whole

    def score(self, text: list[str]) -> float:
        """The ratio of the most toxic passage."""
        return self.features(text)[0]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the columns of x and an intercept by Newton steps with a small ridge; columns are scaled by their deviations."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.array([0.1] * x.shape[1] + [1e-3])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return np.append(w[:-1] / scale, w[-1])


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``logistic`` with weights of 0 or more: columns whose weight would be negative go."""
    use = np.arange(x.shape[1])
    while True:
        w = logistic(x[:, use], y)
        if not len(use) or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = w[:-1], w[-1]
            return out
        use = np.delete(use, w[:-1].argmin())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: What a worker has unpacked last: the bytes and what they hold.
_unpacked: tuple[bytes, object] = (b"", None)


def _pack(thing) -> bytes:
    return zlib.compress(pickle.dumps(thing, pickle.HIGHEST_PROTOCOL), 1)


def _unpack(sent):
    """What broadcast bytes hold, unpacked once a worker; the driver never unpacks them."""
    global _unpacked
    if _unpacked[0] is not sent.value:
        _unpacked = (sent.value, pickle.loads(zlib.decompress(sent.value)))
    return _unpacked[1]


def _one(df: DataFrame, f) -> bytes:
    """The bytes that ``f`` makes of all rows of a bounded table, in one task."""

    def run(frames):
        yield pd.DataFrame({"bytes": [f(pd.concat(list(frames)))]})

    return df.coalesce(1).mapInPandas(run, "bytes binary").first()["bytes"]


def _document_frequency(docs: DataFrame, vocab, text: str = "text") -> DataFrame:
    """(i, n): in how many of all documents the i-th word of the bounded vocabulary stands."""

    def count(batches):
        known = _unpack(vocab)
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for t in b["t"]:
                for w in set(words(t)):
                    i = known.get(w)
                    if i:
                        n[i - 1] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"i": at + 1, "n": n[at]})

    found = docs.select(F.col(text).alias("t")).mapInPandas(count, "i long, n long")
    return written(found.groupBy("i").agg(F.sum("n").alias("n")), "frequencies")


def learnt(texts: list[list[str]], y: list[int], shared: dict[str, int], vocab: dict[str, int], prior: float) -> tuple[KneserNey, np.ndarray, float]:
    """The model of all texts and the curve's weights, from ratios of models that have not met the text."""
    # Copies fall into one fold, so that no text is scored by a model that has met it.
    fold = [zlib.crc32(" ".join(t[:8]).encode()) % 2 for t in texts]
    x = np.zeros((len(texts), 2))
    for f in (0, 1):
        own = [k for k in range(len(texts)) if fold[k] != f]
        m = KneserNey([texts[k] for k in own], [y[k] for k in own], shared, vocab)
        for k in range(len(texts)):
            if fold[k] == f:
                x[k] = m.features(texts[k])
    weights = rising(x, np.array(y, float))
    part = sum(y) / len(y)
    # The sample's share of toxic rows differs from that of all labelled rows.
    weights[-1] += np.log(prior / (1 - prior)) - np.log(part / (1 - part))
    return KneserNey(texts, y, shared, vocab).slim(), weights, prior


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """Packed (model, weights, prior) from labelled rows that are not held out; model None if a class is empty. The bounded sample is fitted in one task."""
    spark = docs.sparkSession
    train = labels.where(~held_out()).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y"))
    text = F.coalesce("text", F.lit(""))
    prints = docs.select("doc_id", F.xxhash64(text).alias("h"), (F.length(text) <= SAMPLE_CHARS).alias("fits"))
    # One row per distinct text and class; texts themselves are neither shuffled nor sorted.
    distinct = prints.join(train, "doc_id").groupBy("y", "h", "fits").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    distinct = written(distinct, "train")
    have = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    prior = have.get(1, 0) / max(1, sum(have.values()))
    some = [distinct.where("fits").drop("n", "fits").where(F.col("y") == y).orderBy("h").limit(SAMPLE) for y in (0, 1)]
    picked = F.broadcast(some[0].union(some[1]))  # at most 2 * SAMPLE rows of three numbers
    found = docs.select("doc_id", text.alias("t"), F.xxhash64(text).alias("h")).join(picked, ["doc_id", "h"])
    sample = written(found.groupBy("y", "h").agg(F.min("t").alias("t")).select("y", "t"), "sample")
    if sample.select("y").distinct().count() < 2:
        return _pack((None, None, prior))

    def read(rows: pd.DataFrame) -> tuple[list[list[str]], list[int]]:
        rows = rows[rows["t"].notna()].sort_values(["y", "t"])
        same: dict[str, str] = {}  # one object a word, or repeats fill the memory
        return [[same.setdefault(w, w) for w in words(t)] for t in rows["t"]], rows["y"].astype(int).tolist()

    def numbered(rows: pd.DataFrame) -> bytes:
        return _pack({w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in read(rows)[0] for w in t))})

    sent = spark.sparkContext.broadcast(_one(sample, numbered))
    shared = _document_frequency(docs, sent)

    def learn(rows: pd.DataFrame) -> bytes:
        vocab = _unpack(sent)
        name = [None, *vocab]
        often = rows[rows["i"].notna()]
        counts = {name[int(i)]: int(n) for i, n in zip(often["i"], often["n"])}
        return _pack(learnt(*read(rows), counts, vocab, prior))

    found = _one(sample.unionByName(shared, allowMissingColumns=True), learn)
    sent.unpersist()
    return found


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    with arrow_batches(docs.sparkSession, BATCH):
        model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf(struct("score double, predicted int"))
    def go(texts: pd.Series) -> pd.DataFrame:
        m, weights, prior = _unpack(model)
        s = np.full(len(texts), float(prior))
        if m and len(texts):
            x = np.array([m.features(words(t)) for t in texts])
            s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        return pd.DataFrame({"score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    return docs.withColumn("_toxicity", go(F.col("text")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out().alias("held_out"), "_toxicity.score", "_toxicity.predicted")

"""The pipeline's dedup stage links by SimHash first; the exact way meets only what is left apart."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from quern.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Groups of a long text and copies with one other word, far from each other."""
    r = random.Random(11)
    texts = []
    for g in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(2500)]
        texts.append(base)
        texts += [[*base[:k], f"e{g}", *base[k + 1 :]] for k in (5, 1200, 2400)]
    return [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]


def kept(spark, rows):
    return sorted(r["doc_id"] for r in corpus_pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "").collect())


def test_simhash_links_and_leaves_them_to_no_other_way(spark, monkeypatch):
    seen, pairs = [], near_copies._pairs

    def noted(a, b, cond):
        seen.append(pairs(a, b, cond).count())
        return pairs(a, b, cond)

    monkeypatch.setattr(near_copies, "_pairs", noted)
    assert kept(spark, corpus()) == [0, 4, 8, 12, 16, 20]
    assert seen and not any(seen)


def test_what_simhash_misses_is_found_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "links", lambda nodes, segments=7: nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false"))
    assert kept(spark, corpus()) == [0, 4, 8, 12, 16, 20]


def test_fingerprint_pairs_connect_what_is_within_the_budget(spark):
    r = random.Random(5)
    fps = [0, 0, 0]
    for _ in range(60):
        x = r.getrandbits(64)
        fps += [x, x, x ^ 1, x ^ 0b1111 << r.randrange(60), x ^ 0b11111 << r.randrange(59)]
    nodes = spark.createDataFrame([(i, (x ^ 1 << 63) - (1 << 63)) for i, x in enumerate(fps)], "node long, fp long")
    own = list(range(len(fps)))
    for u, v in [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= simhash.TAU]:
        own = [own[v] if o == own[u] else o for o in own]
    got = list(range(len(fps)))
    for p in near_copies._fingerprinted(nodes).collect():
        assert bin(fps[p["u"]] ^ fps[p["v"]]).count("1") <= simhash.TAU
        got = [got[p["v"]] if o == got[p["u"]] else o for o in got]
    same = lambda c: {frozenset(i for i, o in enumerate(c) if o == k) for k in c}
    assert same(got) == same(own)

"""The last rounds of the pipeline's dedup stage: settled shingles leave them, rounds read few texts, and no table stays behind."""

import random

import corpus_pipeline
import pytest
from quern.llm import near_copies
from quern.plans import tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def smallest(texts):
    """The smallest number of each group of near copies."""
    sets, own = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if own[i] != own[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = max(own[i], own[j]), min(own[i], own[j])
                own = [y if g == x else g for g in own]
    return sorted(set(own))


def passages():
    """Texts of few passages: their shingles are common, and some texts are near copies."""
    r = random.Random(5)
    base = [[f"p{k}w{i}" for i in range(30)] for k in range(5)]
    texts = [" ".join(w for _ in range(4) for w in r.choice(base)) for _ in range(120)]
    return texts + [t.replace("w7 ", f"x{k} ", 1) for k, t in enumerate(texts[:40])]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("rounds", [0, 2])
def test_rounds_equal_brute_force(spark, monkeypatch, rounds):
    for name, value in (("PAIR_LIMIT", 4), ("CENTERS", 1), ("ROUNDS", rounds)):
        monkeypatch.setattr(near_copies, name, value)
    texts = passages()
    out = corpus_pipeline.dedup(spark, frame(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in out) == smallest(texts)


def test_settled_shingles_leave_and_no_table_stays(spark, monkeypatch):
    seen, written, before = [], near_copies.written, set(tables._paths)

    def noted(df, name, **options):
        out = written(df, name, **options)
        if {"key", "node", "bitmap"} <= set(df.columns):
            seen.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", noted)
    r = random.Random(3)
    base = [f"c{k}" for k in range(120)]
    texts = [" ".join([*base[:k], f"e{i}", *base[k:]]) for i, k in enumerate(r.randrange(120) for _ in range(90))]
    out = corpus_pipeline.dedup(spark, frame(spark, texts), "").collect()
    assert [r["doc_id"] for r in out] == [0]
    assert seen[0] > 0 and seen[-1] == 0
    assert len(set(tables._paths) - before) == 1  # the names of the rows kept, which the result reads

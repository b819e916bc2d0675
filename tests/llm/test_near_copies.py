"""The pipeline's dedup stage against brute force over all pairs."""

import random

import corpus_pipeline
from quern.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(sets):
    own = list(range(len(sets)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                own[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    r = random.Random(7)
    texts = []
    for g in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 200))]
        texts += [" ".join(base)] + [edited(r, base, k) for k in (1, 2, 3, 4, 5)]
    # A cluster beyond PAIR_LIMIT, partly too far edited, and short, empty and common texts.
    base = [f"c{k}" for k in range(120)]
    texts += [edited(r, base, r.choice([1, 2, 3, 6])) for _ in range(150)]
    texts += ["a b", "a b", "a c", "", None, " ", "a b c d e", "a b c d e f"]
    return [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(texts, 1)]


def test_dedup_stage_equals_brute_force(spark):
    rows = corpus()
    assert sum(5 * len(a & b) >= 4 * len(a | b) for a, b in [(grams(rows[0][1]), grams(r[1])) for r in rows[1:6]]) > 0
    rows += rows[:10] * 2  # exact repeated rows, with and without doc_id
    own = groups([grams(r[1]) for r in rows])
    best = {}
    for g, r in zip(own, rows):
        best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    out = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert len(out) == len(best)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted(best.values())


def test_rows_without_doc_id_join_their_group(spark):
    rows = [(None, "a b c d e f", "en", "s", 1)] * 3 + [(7, "a b c d e f", "en", "s", 1)] * 2 + [(None, "g h i j k l", "en", "s", 1)] * 2
    out = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in out) == [(0, "g"), (7, "a")]


def test_prefix_and_jaccard_bounds():
    a = near_copies.shingles(" ".join(map(str, range(104))))
    b = near_copies.shingles(" ".join(map(str, range(84))))
    assert len(a) == 100 and near_copies.similar(a, b) and not near_copies.similar(a, b[1:])


def test_bitmaps_never_differ_more_than_their_sets():
    r = random.Random(9)
    for _ in range(200):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 300))]
        a, b = near_copies.shingles(" ".join(words)), near_copies.shingles(edited(r, words, r.randrange(0, 5)))
        x, y = near_copies.bitmap(a), near_copies.bitmap(b)
        differ = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in x ^ y)
        both = len(set(a.tolist()) & set(b.tolist()))
        assert differ <= len(a) + len(b) - 2 * both
        assert not near_copies.similar(a, b) or 9 * differ <= len(a) + len(b)

"""Expressions that only their pair of words tells apart."""

import random

from quern.llm.toxicity import KneserNey


def model(n, m=200):
    r = random.Random(5)
    filler = lambda: [f"w{r.randrange(200)}" for _ in range(20)]
    # Each class holds both words as often, in these two orders.
    texts = [filler() + ["red", "fox"] + filler() for _ in range(n)] + [filler() + ["fox", "red"] + filler() for _ in range(m)]
    return KneserNey(texts, [1] * n + [0] * m, {})


def test_every_pair_counts():
    for n in (4, 30):
        m = model(n)
        pair = {(a, b): m.vocab[a] * m.v + m.vocab[b] for a, b in (("red", "fox"), ("fox", "red"))}
        assert set(pair.values()) <= set(m.keys.tolist())
        assert m.score(["red", "fox"]) > m.score(["fox", "red"])


def test_pairs_of_one_text_stay():
    m = KneserNey([["a", "b"], ["c", "d"], ["c", "e"]], [1, 0, 0], {})
    assert len(m.keys) == 5


def test_lower_order_counts_predecessors():
    # "x" stands in as many toxic texts as "y", but follows many words; "y" always follows one.
    toxic = [[f"p{k}", "x", "q", "y"] for k in range(9)]
    m = KneserNey([*toxic, ["x", "y"]], [1] * 9 + [0], {})
    assert m.low[m.vocab["x"]] > m.low[m.vocab["y"]] + 0.3

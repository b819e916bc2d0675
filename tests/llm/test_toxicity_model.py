"""The Kneser-Ney models against a plain program, as distributions, and the curve's weights."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import toxicity as tox


def corpus(seed):
    rng = random.Random(seed)
    some = [f"w{k}" for k in range(12)]
    texts = [[rng.choice(some) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    return texts, [rng.randrange(2) for _ in texts], Counter({w: rng.randint(1, 50) for w in some[:9]})


def plain(texts, toxic, shared, vocab):
    """P(class, context, word) by the sums in words; None is a start, 0 an unknown word."""
    counts = [Counter(), Counter()]
    for t, y in zip(texts, toxic):
        ids = [vocab[w] for w in t]
        counts[y].update(set(zip([None, *ids[:-1]], ids)))
    pool = counts[0] + counts[1]
    whole = sum(tox.FLOOR + n for n in [0, *(shared.get(w, 0) for w in vocab)])
    base = {i: (tox.FLOOR + shared.get(w, 0)) / whole for w, i in vocab.items()} | {0: tox.FLOOR / whole}
    keep = lambda n: max(n - tox.DISCOUNT, 0)
    off = lambda n: min(n, tox.DISCOUNT)

    def p(y, h, w):
        stands = Counter(b for _, b in counts[y])
        n = sum(stands.values())
        rest = sum(map(off, stands.values())) + tox.SHARED * n
        low = (keep(stands[w]) + rest * base[w]) / (n * (1 + tox.SHARED)) if n else base[w]
        of = lambda c: {b: m for (a, b), m in c.items() if a == h}
        both, own = of(pool), of(counts[y])
        total = sum(both.values())
        if not total:
            return low
        pair = (keep(both.get(w, 0)) + sum(map(off, both.values())) * low) / total
        back = tox.BACKOFF * total
        return (keep(own.get(w, 0)) + (sum(map(off, own.values())) + back) * pair) / (sum(own.values()) + back)

    return p


@pytest.mark.parametrize("seed", range(4))
def test_models_are_distributions_and_equal_a_plain_program(seed):
    texts, toxic, shared = corpus(seed)
    m = tox.KneserNey(texts, toxic, shared)
    p = plain(texts, toxic, shared, m.vocab)
    for h in range(m.v + 1):
        got = m.probabilities(h)
        assert np.allclose(got.sum(1), 1)
        want = [[p(y, None if h == m.v else h, w) for w in range(m.v)] for y in (0, 1)]
        assert np.allclose(got, want)
    for text in ([], ["w3"], ["w1", "new", "w2", "w2"], [*texts[0], "w5"]):
        ids = [m.vocab.get(w, 0) for w in text]
        r = [math.log(p(1, a, b) / p(0, a, b)) for a, b in zip([None, *ids[:-1]], ids)]
        n = tox.PASSAGE
        best = max(sum(r[k : k + n]) for k in range(max(1, len(r) - n + 1))) / n if r else 0.0
        assert m.features(text) == pytest.approx((best, sum(r) / len(r) if r else 0.0), abs=1e-5)


def test_more_toxic_never_scores_lower():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(float)
    w = tox.rising(x, y)
    assert w[0] > 0 and w[1] == 0 and (w[:-1] >= 0).all()

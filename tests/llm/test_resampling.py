"""Importance resampling against a plain program; blocks of any size, odd rows, words in bytes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(w):
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def plain(docs, target, buckets, share=25, least=20):
    s, t = Counter(), Counter()
    own = [features(words(text)) for _, text, *_ in docs]
    for into, many in ((s, own), (t, [features(words(x[0])) for x in target])):
        for f in many:
            for k, n in f.items():
                into[zlib.crc32(k.encode()) % buckets] += n
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (sum(s.values()) + buckets)) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for (i, text, *_), f in zip(docs, own):
        n = sum(f.values())
        weight = sum(c * gain[zlib.crc32(k.encode()) % buckets] for k, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: share * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn(spark, docs, target, schema="doc_id long, text string", **how):
    d, t = spark.createDataFrame(docs, schema), spark.createDataFrame(target, "text string")
    return sorted((tuple(r) for r in resampling.resample(d, t, **how).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3000, 1 << 20])
def test_equals_a_plain_program(spark, block):
    rng = random.Random(block)
    some = [f"{a}{b}" for a in ("ga", "Ré", "x1", "ζ") for b in range(30)]
    docs = [(i, rng.choice([" ", ", ", "\t"]).join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(1000 + i, "the the the " * 20) for i in range(186)]  # copies, and one word in most of the text
    target = [(" ".join(some[:12] * 3),), ("the end",), (None,)]
    assert drawn(spark, docs, target, block=block, buckets=97) == plain(docs, target, 97)


def test_odd_rows(spark):
    docs = [(1, None, 5), (2, "", 5), (3, "one two " * 30, 5), (3, "one two " * 30, 5), (None, "Ünder_score ΑΒ " * 12, 5), (4, "z" * 70_000 + " tail", 5), (5, " \x7f{}~ ", 5)]
    got = drawn(spark, docs, [("two one",)], "doc_id long, text string, weight long", buckets=50, block=100, share=70)
    assert got == plain(docs, [("two one",)], 50, share=70) and sum(r[4] is not None for r in got) == 2
    assert drawn(spark, [(1, None)], []) == plain([(1, None)], [], 10_000)
    assert drawn(spark, [], [("a",)]) == []


def test_words_are_those_of_the_pattern():
    texts = ["Aa-b_c9", "", "x", "y z", "é　ß`k", "@[z{", "end"]
    found, owner = resampling.words([t.encode() for t in texts])
    assert list(zip(owner.tolist(), found.to_pylist())) == [(i, w.encode()) for i, t in enumerate(texts) for w in words(t)]

"""The prefix trie against its SQL and a plain program, with chunks of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quern.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by brute force: every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + seq[h:])
    members = defaultdict(list)
    for c, seq in sorted(made.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in who if len(made[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((who[0], len(p), up, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, chunk, schema=SCHEMA):
    made = trie.rebuilt(trie.turn_sequences(spark.createDataFrame(rows, schema)))
    return sorted((tuple(r) for r in trie.prefix_trie(made, chunk).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_brute_force_whatever_the_chunks(spark, seed):
    rng = random.Random(seed)
    rows = [(c, k, rng.choice(["user", "bot"][: 1 + (k > 1)]), rng.choice(["", "é", "ab"][: 1 + seed])) for c in rng.sample(range(700), 90) for k in range(rng.randint(1, 9))]
    rows += [(c, k, "user", "copy") for c in range(1000, 1060) for k in range(3)]  # copies over many chunks
    rows += [(2000, k, "user", "x" * k) for k in range(120)]
    want = plain(rows)
    for chunk in (1, 400, 1 << 20):
        assert nodes(spark, rows, chunk) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost", 1), (5, None, None, None, 1), (5, 2, "user", "b", 1), (5, 2, "user", "b", 1), (5, 2, "bot", "a", 1), (705, 1, "u", "only", 1), (9, 1, None, "long" * 50_000, 1), (-101, 1, "u", "below", 1)]
    got = nodes(spark, rows, 200, SCHEMA + ", path long")
    assert got == plain(rows)
    assert nodes(spark, [], 200) == []
    assert [c for c, _ in trie.prefix_trie(trie.rebuilt(trie.turn_sequences(spark.createDataFrame([], SCHEMA)))).dtypes] == [f.split(" ")[0] for f in trie.NODES.split(", ")]


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # its group's first conversation is absent
    got = nodes(spark, [(c, 1, "u", "x")], 1)
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]

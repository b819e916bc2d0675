"""Secret scan with a password guess-cost dynamic program.

Base patterns find assignments, access keys and hexadecimal runs. Values that
stand in a credential context (``pwd: ...``, ``db_password = ...``) are then priced by the
cheapest way to guess them: a minimum-cost segmentation into common words,
dates, repeats, keyboard walks and brute-force spans. Values dear to guess
become further spans of kind ``guess``, and so do values of which a base span covers only a
part; values wholly in one base span do not. Base spans always stay.

Common words are those of a small list and, where a ``vocabulary`` file is given, its
whole words, commonest first; the file is read once in each worker.

Spans are those of the whole pattern match, in code points, end exclusive.
Null texts count as empty; empty texts have no spans and the SHA-256 of "".
Repeated rows give repeated results; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import TYPES, struct, table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# The three base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Names of credentials; one counts up to the end of its part of an identifier, and other parts may follow.
NAME = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?|login|auth(?:orization)?)(?=[_-]|$)", re.I | re.A)
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]+", re.A)
SEPARATOR = re.compile(r"""["']?[\x20\t]*[:=][\x20\t]*(["']?)""")
BROKEN = re.compile(r"[_-]{2,}")
VALUE = re.compile(r"""[^\s"'<>,;]*""")
LEAST = 8
#: Marks that end a sentence rather than a value.
STRIPPED = ".#*%&$!?)"
KINDS = ("assign", "access", "hex", "guess")
#: A value is a secret of kind ``guess`` from this many guesses (log10) on.
MIN_LOG10_GUESSES = 10.0

# Common words of passwords and placeholders, commonest first.
WORDS = """password admin secret token login welcome letmein qwerty dragon master monkey shadow sunshine princess
football baseball iloveyou superman batman trustno hello freedom whatever michael jordan hunter killer summer winter
spring autumn monday friday january march april june july august october november december london paris berlin
changeme default example sample test testing demo guest user root system server database oracle mysql public private
access manager account email mail home house love money computer internet google apple windows linux company service
key api auth code pass word your here none null true false value string insert placeholder redacted hidden removed
the and for with this that from have not you are was will can all new old""".split()
LEET = str.maketrans("@4310$57", "aaeiosst")
# Rows of the usual keyboard, plain and with shift.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
UNSHIFT = str.maketrans("".join(SHIFTED), "".join(ROWS))
PLACE = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row) if c != " "}
#: Steps to the six neighbours of a key on the slanted keyboard.
STEPS = {(1, 0), (-1, 0), (0, 1), (-1, 1), (0, -1), (1, -1)}
# Dates as year-month-day, day-month-year, and years alone.
DATES = (
    (re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", re.A), 4.6),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.A), 4.6),
    (re.compile(r"(?:19|20)\d\d", re.A), 2.1),
)
#: Repeats are blocks of at most so many characters, any number of times.
BLOCK = 8
WALK, TURN, VARIANT, JOIN = 1.7, 0.4, 0.3, math.log10(2)


@lru_cache(4)
def ranks(vocabulary: str | None = None) -> tuple[dict[str, float], int]:
    """log10 of the rank of each common word, and the longest word's length."""
    words = list(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        whole = [t[: len(t) - len(end)] for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end)]
        words += [w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha()]
    out = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
    return out, max(map(len, out))


class _Starts:
    """Starts of one run: the least of cost(start) + log10(units since the start), exactly.

    The logarithm grows ever more slowly, so a later start that is no better than an
    earlier one now never is again and goes; few stay.
    """

    def __init__(self):
        self.kept: list[tuple[float, int]] = []

    def add(self, cost: float, at: int) -> None:
        self.kept.append((cost, at))

    def least(self, now: int) -> float:
        best, kept = math.inf, []
        for cost, at in self.kept:
            c = cost + math.log10(now - at)
            if c < best:
                best = c
                kept.append((cost, at))
        self.kept = kept
        return best


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    The least sum over all segmentations of the segments' costs and log10(2) for each segment:

    * a common word, plain or with capitals or leet: log10 of its rank, 0.3 for each kind of change;
    * a date: 4.6, a year 2.1;
    * two or more of the same block of at most BLOCK characters, three characters at least: the block's
      characters and log10 of the number of blocks;
    * three or more keys that each touch the next: 1.7, log10 of the number of keys, 0.4 for each turn;
    * any other span: 1 a character.
    """
    rank, longest = ranks(vocabulary)
    n = len(value)
    low = value.translate(LOWER)
    plain = low.translate(LEET)
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in range(n - 2):
        for size in range(3, min(longest, n - m) + 1):
            p = plain[m : m + size]
            if p in rank:
                w = low[m : m + size]
                ends.setdefault(m + size, []).append((m, rank[p] + VARIANT * ((value[m : m + size] != w) + (p != w))))
        if value[m].isdigit():
            for pattern, cost in DATES:
                d = pattern.match(value, m)
                if d:
                    ends.setdefault(d.end(), []).append((m, cost))
    keys = [PLACE.get(c) for c in value.translate(UNSHIFT)]
    step = [None] * n  # the step to key k, if the one before touches it
    for k in range(1, n):
        a, b = keys[k - 1], keys[k]
        if a and b and (b[0] - a[0], b[1] - a[1]) in STEPS:
            step[k] = (b[0] - a[0], b[1] - a[1])
    turns = [0] * n  # turns of the run up to key k
    for k in range(2, n):
        turns[k] = turns[k - 1] + (step[k] is not None and step[k - 1] is not None and step[k] != step[k - 1])
    same = [0] * (BLOCK + 1)  # so many characters up to here equal those p before
    repeats: list[dict[int, _Starts]] = [{} for _ in range(BLOCK + 1)]
    walk, walked = _Starts(), 0
    # brute: best cost with an open brute-force span that ends here
    best, brute = [0.0] * (n + 1), math.inf
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + JOIN) + 1.0
        least = brute
        for i, cost in ends.get(j, ()):
            least = min(least, best[i] + cost + JOIN)
        k = j - 1
        walked = walked + 1 if step[k] else 0
        if walked < 2:
            walk = _Starts()
        else:
            a = j - 3  # the newest start that leaves three keys; turns before its second step do not count
            walk.add(best[a] - TURN * turns[a + 1], a)
            least = min(least, walk.least(j) + TURN * turns[k] + WALK + JOIN)
        for p in range(1, BLOCK + 1):
            same[p] = same[p] + 1 if k >= p and low[k] == low[k - p] else 0
            r = 3 if p == 1 else 2
            if same[p] < (r - 1) * p:
                if repeats[p]:
                    repeats[p] = {}
                continue
            found = repeats[p].setdefault(j % p, _Starts())
            found.add(best[j - r * p], j // p - r)
            least = min(least, found.least(j // p) + p + JOIN)
        best[j] = least
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, leftmost and non-overlapping by kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential context, in order and apart from each other.

    A value stands behind an identifier that names a credential, and a separator: a whole quoted string on one line, else a run up to white space, quotes, <, >,
    comma or semicolon, of LEAST characters at least. A value that itself begins with the name of another value gives way to that one, so chains of names lead to
    the last; other names within a value open none of their own. Every character is looked at a bounded number of times.
    """
    found = []  # (start of the identifier, start and end of the value)
    run = kept = -1  # ends of the last run of characters, with and without marks behind it
    for m in IDENTIFIER.finditer(text):
        at, end = m.span()
        name = m.group()
        if name[-1] in "_-":
            continue
        sep = SEPARATOR.match(text, end)
        if not sep:
            continue
        for broken in BROKEN.finditer(name):  # parts of an identifier have one mark between them
            at = m.start() + broken.end()
        if not NAME.search(name, at - m.start()):
            continue
        start, quote = sep.end(), sep.group(1)
        if quote:
            close = text.find(quote, start)
            line = text.find("\n", start, close) if close >= 0 else 0
            if close >= 0 and line < 0:
                found.append((m.start(), start, close))
                continue
        if start >= run:
            value = VALUE.match(text, start)
            run, kept = value.end(), start + len(value.group().rstrip(STRIPPED))
        found.append((m.start(), start, kept))
    found = [f for f in found if f[2] - f[1] >= LEAST]
    out, done = [], 0
    for k, (_, s, e) in enumerate(found):
        if s >= done and not (k + 1 < len(found) and found[k + 1][0] == s):
            out.append((s, e))
            done = e
    return out


def guess_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str | None = None) -> list[tuple[int, int, int]]:
    """Values in credential context that are dear to guess; none that lies wholly in one base span.

    A base span over a part marks the value as a secret whatever its cost, so that no rest of it stays in the text.
    """
    out, k, reach = [], 0, []
    for s, e in context_values(text):
        while k < len(base) and base[k][0] < e:
            reach.append(base[k])
            k += 1
        reach = [x for x in reach if x[2] > s]  # the base spans over a part of the value
        if any(a <= s and e <= b for a, _, b in reach):
            continue
        if reach or guess_cost(text[s:e], vocabulary) >= MIN_LOG10_GUESSES:
            out.append((s, 3, e))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scan(text: Column, vocabulary: str | None = None) -> Column:
    """Struct of counts and spans of one whole text."""

    @F.pandas_udf(struct(FIELDS))
    def go(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            more = guess_spans(t, base, vocabulary)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + more)), len(more)))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in FIELDS.split(", ")])

    return go(text)


def redacted(t: str | None, vocabulary: str | None = None) -> str | None:
    """The text with every span as ``[SECRET]``; overlapping spans become one."""
    if not t:
        return t
    base = base_spans(t)
    out, at = [], 0
    for s, _, e in sorted(base + guess_spans(t, base, vocabulary)):
        if e > at:
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = e
    return "".join(out) + t[at:]


def redact(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with all texts redacted."""

    @F.pandas_udf(TYPES["string"])
    def go(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, vocabulary))

    return docs.withColumn(text, go(F.col(text)))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = scan(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", found.alias("s")).select("doc_id", "s.*")

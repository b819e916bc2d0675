"""BPE encoding and decoding by tree concatenation.

Every text is a tree: it is halved anywhere, within words too, down to leaves of at most LEAF characters.
All leaves of a text are encoded in one call of the tokenizers library, which deals them to its threads where TOKENIZERS_PARALLELISM is on. Then
halves are concatenated: windows around each join are encoded again and grow until their first and last codes
agree exactly with what both sides have there. Chunks between white space are the units of these windows; a chunk of more than LEAF characters is
a tree of its own, whose windows are made of tokens: it is normalised and split by the tokenizer's own rules,
halves of long pieces are encoded in parallel, and a window agrees once each token at its edges and its outer neighbour re-encode to themselves.

Each worker remembers the codes of up to MEMO short chunks. Null texts count as empty: no ids, and the SHA-256 of "". Lone
surrogates cannot occur in Spark strings. Repeated rows give repeated results, an empty table none; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import struct, table

LEAF = 1024
#: Texts of these characters alone have no white space but ASCII's, are in NFC and keep their length in lower case.
EASY = re.compile(r"[\x09-\x0D\x20-\x7E\xA1-\u012F\u0131-\u017E]*")
MARKS = frozenset(".,;:!?")
SPACE = frozenset("\t\n\v\f\r ")
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
LONG = re.compile(r"[^\x20\x09-\x0D]{%d,}" % (LEAF + 1))
#: Chunks remembered by one worker, and their greatest length.
MEMO, SHORT = 1 << 19, 64
#: Pieces of so many characters have their halves encoded by two threads.
PARALLEL = 8 * LEAF

#: Number of ids, the ids joined by spaces, the decoded text.
Code = tuple[int, str, str]


class TreeBPE:
    """Encoder and decoder of one tokenizer file with BPE word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        self.tok = Tokenizer.from_str(json.dumps(spec))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        inner = dict(spec, model=dict(spec["model"], end_of_word_suffix=None))
        self.inner = Tokenizer.from_str(json.dumps(inner)).model
        self.outer = self.tok.model
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.token = [self.tok.id_to_token(i) for i in range(size)]
        self.number = [str(i) for i in range(size)]
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(rule).findall
        self.ends = [int(bool(self.suffix) and t.endswith(self.suffix)) for t in self.token]
        self.memo: dict[str, Code] = {}
        self._pair = lru_cache(1 << 16)(lambda a, b: self._flat([a, b]) == [a, b])

    def _leaf(self, text: str, end: bool) -> list[int]:
        return [t.id for t in (self.outer if end else self.inner).tokenize(text)] if text else []

    def _flat(self, ids: list[int]) -> list[int]:
        """The ids of the text of ``ids``, encoded afresh."""
        text = "".join(self.token[i] for i in ids)
        end = bool(self.suffix) and text.endswith(self.suffix)
        return self._leaf(text[: -len(self.suffix)] if end else text, end)

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        a, b = min(4, len(left)), min(4, len(right))
        while True:
            mid = self._flat(left[len(left) - a :] + right[:b])
            fits_left = a == len(left) or self._pair(left[-a - 1], mid[0])
            fits_right = b == len(right) or self._pair(mid[-1], right[b])
            if fits_left and fits_right:
                return left[: len(left) - a] + mid + right[b:]
            a = a if fits_left else min(2 * a, len(left))
            b = b if fits_right else min(2 * b, len(right))

    def piece(self, text: str, end: bool = True, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Ids of one pre-token, given in the tokenizer's byte alphabet."""
        if len(text) <= LEAF:
            return self._leaf(text, end)
        half = len(text) // 2
        if pool:
            first = pool.submit(self.piece, text[:half], False)
            right = self.piece(text[half:], end)
            return self._join(first.result(), right)
        return self._join(self.piece(text[:half], False), self.piece(text[half:], end))

    def _run(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if self.special and self.special.fullmatch(part):
                out.append(self.tok.token_to_id(part))
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    if len(piece) > PARALLEL:
                        with ThreadPoolExecutor(2) as pool:
                            out += self.piece(piece, True, pool)
                    else:
                        out += self.piece(piece)
        return out

    def _code(self, ids: list[int]) -> Code:
        return len(ids), " ".join([self.number[i] for i in ids]), self.decode(ids)

    def _new(self, chunks: list[str]) -> list[Code]:
        """Codes of chunks, all encoded in one call: joined by spaces if each pre-token's last id is then told by its word end."""
        text = " ".join(chunks)
        if not self.suffix or not EASY.fullmatch(text) or "<|" in text:
            return [self._code(e.ids) for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        ids, ends, out, at = self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.ends, [], 0
        for w in chunks:
            first, left = at, 1 if w.isalpha() else len(self.split(w))
            while left:
                left -= ends[ids[at]]
                at += 1
            out.append(self._code(ids[first:at]))
        return out

    def _codes(self, chunks: list[str]) -> list[Code]:
        """Codes of chunks; those not remembered are encoded in one call."""
        memo = self.memo
        try:
            return [memo[w] for w in chunks]
        except KeyError:
            new = [w for w in dict.fromkeys(chunks) if w not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(dict.fromkeys(chunks))
        # A word and the mark behind it are two pre-tokens, so their codes are those of both.
        marked = [w for w in new if w[-1] in MARKS and w[:-1] in memo and w[-1] in memo and w[:-1].isalpha()]
        for w in marked:
            (n, a, b), (k, c, d) = memo[w[:-1]], memo[w[-1]]
            memo[w] = (n + k, f"{a} {c}", f"{b} {d}")
        if marked:
            new = [w for w in new if w not in memo]
        if new:
            memo.update(zip(new, self._new(new)))
        out = [memo[w] for w in chunks]
        for w in new:
            if len(w) > SHORT:
                del memo[w]
        return out

    def _concat(self, left: tuple[list, list], right: tuple[list, list], parted: bool) -> tuple[list, list]:
        """Both halves' chunks and codes as one; ``parted`` tells whether a chunk lies across the join."""
        (lw, lc), (rw, rc) = left, right
        if not lw or not rw:
            return (lw, lc) if lw else (rw, rc)
        k = 1
        while True:
            a, b = min(k, len(lw)), min(k, len(rw))
            window = lw[len(lw) - a :] + rw[:b]
            if parted:
                window[a - 1 : a + 1] = [window[a - 1] + window[a]]
            codes = self._codes(window)
            if (a == len(lw) or codes[0] == lc[-a]) and (b == len(rw) or codes[-1] == rc[b - 1]):
                return lw[: len(lw) - a] + window + rw[b:], lc[: len(lc) - a] + codes + rc[b:]
            k *= 2

    def _tree(self, text: str, split) -> list[Code]:
        """Codes of a text without chunks of more than LEAF characters."""
        cuts = [0]

        def halve(a: int, b: int) -> None:
            if b - a <= LEAF:
                cuts.append(b)
            else:
                halve(a, (a + b) // 2)
                halve((a + b) // 2, b)

        halve(0, len(text))
        leaves = [split(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        flat, at = self._codes([w for leaf in leaves for w in leaf]), 0
        done: list[tuple[list, list]] = []
        for leaf in leaves:
            done.append((leaf, flat[at : at + len(leaf)]))
            at += len(leaf)
        ends = cuts[1:]
        while len(done) > 1:  # the tree from its leaves up
            up, last = [], []
            for i in range(0, len(done) - 1, 2):
                m = ends[i]
                up.append(self._concat(done[i], done[i + 1], text[m - 1] not in SPACE and text[m] not in SPACE))
                last.append(ends[i + 1])
            if len(done) % 2:
                up.append(done[-1])
                last.append(ends[-1])
            done, ends = up, last
        return done[0][1]

    def joined(self, text: str | None) -> Code:
        """Number of ids of a whole text, the ids joined by spaces, and the decoded text."""
        text = text or ""
        split = CHUNK.findall
        if EASY.fullmatch(text) and "<|" not in text:  # characters in NFC whose lower case is one character
            text, split = text.lower(), str.split
        got, at = [], 0
        if len(text) > LEAF:
            for m in LONG.finditer(text):
                got += self._tree(text[at : m.start()], split)
                got.append(self._code(self._run(m.group())))
                at = m.end()
        got += self._tree(text[at:], split)
        got = [g for g in got if g[0]]
        return sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.joined(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder does: the tokens, joined by spaces."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(4)
def encoder(path: str) -> TreeBPE:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
    return TreeBPE(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids themselves."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    @F.pandas_udf(struct(fields))
    def go(texts: pd.Series) -> pd.DataFrame:
        e, rows = encoder(path), []
        for t in texts:
            n, plain, back = e.joined(t)
            row = [n, hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
            rows.append([*row, list(map(int, plain.split()))] if with_ids else row)
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in fields.split(", ")])

    return docs.select(F.col(doc_id), go(F.col(text)).alias("b")).select(doc_id, "b.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

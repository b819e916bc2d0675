"""Importance resampling toward a target distribution, through a dictionary of distinct features.

Features are runs of one and two words. Documents are taken in blocks of some BLOCK bytes; a block names each of its distinct features once, with the
documents that hold it and how often. Features meet by their string in one task each (dealt by hashes of their words), where all blocks' strings form
one dictionary: each distinct string is hashed to its bucket once, and its counts add to the bucket's. From the buckets' counts in all documents and in
all target texts follow their gains, which go back to each block's documents by the bucket that the dictionary gave the feature. A feature has one
entry a block however frequent it is, so no string is a hot key; strings are shuffled once, and packed.

The driver sees the counts of the buckets and one count of rows a partition. Draws are the highest keys in one global order by ranges.

Odd input: null texts are empty; a document without words has weight 0; every row is drawn by itself, also a repeated one; a null doc_id is the empty
text in its hash and comes last among equal scores; an empty target counts 0 everywhere; an empty table gives no rows; extra columns are left alone.
Words are found in the bytes of UTF-8, where A-Z are the only ones that change.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written

C = F.col
#: Bytes of text that a block holds at most, but for its last text; bytes of text for one partition of the dictionary.
BLOCK, PART = 8 << 20, 64 << 20
BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 7, 25, 20

# Bytes of words as they count: digits, letters in lower case, and all bytes of other characters; 0 parts words.
_BYTES = np.zeros(256, np.uint8)
_BYTES[48:58], _BYTES[65:91], _BYTES[97:123], _BYTES[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array one after the other, and their lengths."""
    cuts = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return data[cuts[0] : cuts[-1]], np.diff(cuts)


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the place of each one's text."""
    size = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(size) - size
    raw = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    inside = raw != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[size > 0]
    begins[first] = inside[first]  # texts lie side by side
    kept = raw[inside]
    starts = np.flatnonzero(begins[inside])
    owner = np.searchsorted(at, np.flatnonzero(begins), "right") - 1
    return _binaries(kept, np.diff(np.concatenate((starts, [len(kept)])))), owner


def _shrunk(x: np.ndarray, press) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, compressed; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + press(x.astype(f"<u{width}").tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), f"<u{packed[0]}")


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


PACKS = "part int, no long, target boolean, ids array<bigint>, words array<bigint>, lengths binary, data binary, posts binary, docs binary, counts binary"
_PACKS = pa.schema([
    ("part", pa.int32()), ("no", pa.int64()), ("target", pa.bool_()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("lengths", pa.binary()), ("data", pa.binary()),
    ("posts", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
])


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def _packed(texts: list[bytes], target: bool, parts: int):
    """(part, lengths, data, posts, docs, counts) of a block's distinct features, and the words of each text.

    ``posts`` is the number of documents of a feature, ``docs`` and ``counts`` their places in the block and how often they hold it; target texts are one document.
    """
    found, owner = words(texts)
    each = np.bincount(owner, minlength=len(texts))
    if not len(found):
        return [], each
    coded = pc.dictionary_encode(found)
    own, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.zeros(len(owner), np.int64) if target else owner
    v, d = len(own), 1 if target else len(texts)
    joint = owner[1:] == owner[:-1]
    # Words are features 0 .. v - 1, pairs a * v + b + v.
    feature = np.concatenate((code, (code[:-1] * v + code[1:] + v)[joint]))
    key = feature * d + np.concatenate((doc, doc[1:][joint]))
    key.sort()
    at = _runs(key)
    counts = np.diff(np.concatenate((at, [len(key)])))
    key = key[at]
    feature, docs = key // d, key % d
    at = _runs(feature)
    posts, feature = np.diff(np.concatenate((at, [len(feature)]))), feature[at]
    hashed = _spread(np.fromiter((zlib.adler32(w) * 0x1F123BB5 + zlib.crc32(w) for w in own.to_pylist()), np.uint64, v))  # of words, to deal features
    pair = feature >= v
    a = np.where(pair, (feature - v) // v, feature)
    b = np.where(pair, (feature - v) % v, 0)
    to = (_spread(hashed[a] + np.where(pair, _spread(hashed[b]), np.uint64(0))) % np.uint64(parts)).astype(np.int64)
    first = np.cumsum(posts) - posts
    # Within a part features of one document come first, in the order of the documents: their places then take next to no room.
    order = np.argsort((to * 2 + (posts > 1)) * d + docs[first], kind="stable")
    cut = np.searchsorted(to[order], np.arange(parts + 1))
    out = []
    press = zstandard.ZstdCompressor(level=6).compress
    for p in np.flatnonzero(np.diff(cut)):
        mine = order[cut[p] : cut[p + 1]]
        m = posts[mine]
        where = np.repeat(first[mine] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        one, two = own.take(pa.array(a[mine])), pa.array(b[mine])
        text = pc.if_else(pa.array(pair[mine]), pc.binary_join_element_wise(one, own.take(two), pa.scalar(b" ", pa.large_binary())), one)
        data, lengths = _flat(text)
        out.append((int(p), *(_shrunk(x, press) for x in (lengths, data, m, docs[where], counts[where]))))
    return out, each


def _blocks(target: bool, parts: int, block: int):
    """Documents as packs of features and, but for target texts, rows with their ids and words."""

    def run(batches):
        from pyspark import TaskContext

        no, texts, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def rows():
            packs, each = _packed(texts, target, parts)
            out = [] if target else [{"part": no % parts, "ids": ids, "words": each}]
            out += [dict(zip(("part", "lengths", "data", "posts", "docs", "counts"), p)) for p in packs]
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist([{"no": no, "target": target} | r for r in out[a : a + 256]], schema=_PACKS)

        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.large_binary()).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= block:
                    yield from rows()
                    no, texts, ids, size = no + 1, [], [], 0
        if ids:
            yield from rows()

    return run


HASHED = "no long, ids array<bigint>, words array<bigint>, posts binary, docs binary, counts binary, buckets binary, s array<bigint>, t array<bigint>"
_HASHED = pa.schema([
    ("no", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("posts", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("buckets", pa.binary()),
    ("s", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())),
])




def _dictionary(buckets: int):
    """All packs of a partition through one dictionary: every pack with its features' buckets, and the partition's counts by bucket."""

    def run(batches):
        packs = []
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    yield pa.RecordBatch.from_pylist([{"no": r["no"], "ids": r["ids"], "words": r["words"]}], schema=_HASHED)
                else:
                    packs.append(r)
        if not packs:
            return
        strings = pa.concat_arrays([_binaries(_numbers(r.pop("data")), _numbers(r.pop("lengths"))) for r in packs])
        coded = pc.dictionary_encode(strings)
        distinct = coded.dictionary
        hashed = np.fromiter((zlib.crc32(f) % buckets for a in range(0, len(distinct), 1 << 16) for f in distinct.slice(a, 1 << 16).to_pylist()), np.int32, len(distinct))
        own = hashed[coded.indices.to_numpy(zero_copy_only=False)]
        del strings, coded, distinct
        at, whole = 0, {True: np.zeros(buckets, np.int64), False: np.zeros(buckets, np.int64)}
        for r in packs:
            posts = _numbers(r["posts"])
            mine = own[at : at + len(posts)]
            at += len(posts)
            np.add.at(whole[r["target"]], np.repeat(mine, posts), _numbers(r["counts"]).astype(np.int64))
            if not r["target"]:
                packed = _shrunk(mine, zstandard.ZstdCompressor(level=3).compress)
                yield pa.RecordBatch.from_pylist([{"no": r["no"], "posts": r["posts"], "docs": r["docs"], "counts": r["counts"], "buckets": packed}], schema=_HASHED)
        yield pa.RecordBatch.from_pylist([{"s": whole[False], "t": whole[True]}], schema=_HASHED)

    return run


SUMS = "no long, ids array<bigint>, words array<bigint>, sums binary"
_SUMS = pa.schema([("no", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("sums", pa.binary())])


def _gained(gains: np.ndarray):
    """What a task's packs bring each document of a block, as one row a block."""

    def run(batches):
        for b in batches:
            sums: dict[int, np.ndarray] = {}
            for r in b.to_pylist():
                docs = _numbers(r["docs"])
                most = int(docs.max())
                gain = np.repeat(gains[_numbers(r["buckets"])], _numbers(r["posts"])) * _numbers(r["counts"]).astype(np.int64)
                own = sums.get(r["no"], np.zeros(0, np.int64))
                if len(own) <= most:
                    own = np.concatenate((own, np.zeros(most + 1 - len(own), np.int64)))
                np.add.at(own, docs, gain)
                sums[r["no"]] = own
            press = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_pylist([{"no": no, "sums": press(own.tobytes())} for no, own in sums.items()], schema=_SUMS)

    return run


def _whole(block: pa.Table) -> pa.Table:
    """The documents of one block with the gains of all their features."""
    rows = block.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    gain = np.zeros(len(own["ids"]), np.int64)
    for r in rows:
        if r["sums"] is not None:
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sums"]), np.int64)
            gain[: len(part)] += part
    return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "n_words": pa.array(own["words"], pa.int64()), "gain": pa.array(gain)})


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text), ``target`` (text) being the distribution aimed at."""
    spark = docs.sparkSession
    text = F.coalesce(C("text").cast("string"), F.lit("")).alias("text")
    docs, target = docs.select(C("doc_id").cast("long").alias("doc_id"), text), target.select(F.lit(0).cast("long").alias("doc_id"), text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    packs = docs.mapInArrow(_blocks(False, parts, block), PACKS).unionByName(target.mapInArrow(_blocks(True, parts, block), PACKS))
    hashed = written(packs.repartitionById(parts, "part").mapInArrow(_dictionary(buckets), HASHED), "features")
    counts = hashed.where("s is not null").select(F.posexplode(F.arrays_zip("s", "t")).alias("bucket", "n")).groupBy("bucket").agg(F.sum("n.s").alias("s"), F.sum("n.t").alias("t"))
    every = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((C("t") + 1) * (C("all_s") + buckets)).cast("double") / ((C("s") + 1) * (C("all_t") + buckets)).cast("double")
    gains = np.zeros(buckets, np.int64)
    for r in counts.crossJoin(F.broadcast(every)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():  # as many rows as buckets
        gains[r["bucket"]] = r["gain"]
    gained = hashed.where("buckets is not null").select("no", "posts", "docs", "counts", "buckets").mapInArrow(_gained(gains), SUMS)
    own = hashed.where("ids is not null").select("no", "ids", "words", F.lit(None).cast("binary").alias("sums"))
    both = own.unionByName(gained).groupBy("no").applyInArrow(_whole, "doc_id long, n_words long, gain long")
    features = C("n_words") + F.greatest(C("n_words") - 1, F.lit(0))
    weight = F.when(C("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return both.withColumn("n_features", features).select("doc_id", "n_words", "n_features", weight.alias("weight"))


def _numbered(batches):
    """Rows in order with their partition and the place of eligible ones in it, from 1."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for b in batches:
        ok = b["eligible"].to_numpy(zero_copy_only=False).astype(np.int64)
        place = seen + np.cumsum(ok)
        seen = int(place[-1]) if len(place) else seen
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(ok), part, np.int64)), pa.array(place)], [*b.schema.names, "part", "place"])


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``share`` per cent of the rows with ``least_words`` words are drawn, the highest scores, which add Gumbel noise to weights."""
    rows = weights(docs, target, buckets, block)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(C("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.select("doc_id", "n_features", "weight", (C("weight") + noise).alias("score"), (C("n_words") >= least_words).alias("eligible"))
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(ordered.mapInArrow(_numbered, "doc_id long, n_features long, weight long, score long, eligible boolean, part long, place long"), "ordered")
    before, n = [], 0
    for r in ordered.groupBy("part").agg(F.count_if("eligible").alias("n")).orderBy("part").collect():
        before.append((r["part"], n))
        n += r["n"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))  # a row for each partition
    rank = C("place") + C("before")
    return ordered.join(offsets, "part").select("doc_id", "n_features", "weight", "score", F.when(C("eligible") & (rank <= n * share // 100), rank).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
split AS (SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT r, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
counted AS (SELECT r, target, f, count(*) AS n FROM feats GROUP BY ALL),
dict AS (SELECT f, sum(CASE WHEN target THEN 0 ELSE n END) AS s, sum(CASE WHEN target THEN n ELSE 0 END) AS t FROM counted GROUP BY f),
hashed AS (SELECT f, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hex(f)) // 2), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM dict, steps),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM sums) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM sums) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums),
gained AS (SELECT r, sum(n) AS n, sum(n * gain) AS gain FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY r),
scored AS (SELECT doc_id, len(w) >= 20 AS ok, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(gain AS DOUBLE) / n), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise
  FROM split LEFT JOIN gained USING (r) WHERE NOT target),
ranked AS (SELECT doc_id, n_features, weight, weight + noise AS score, ok, row_number() OVER (PARTITION BY ok ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= total * 25 // 100 THEN place END AS rank FROM ranked
"""

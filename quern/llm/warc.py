"""Dictionary-compressed WARC archives.

An archive is a file of the shared folder: a leading skippable frame that embeds a Zstandard
dictionary, then one frame per record. Every partition writes archives of about ARCHIVE_BYTES through
Spark's own file commit, which survives lost executors. Frames are written as lines whose separator is itself an empty
skippable frame, so that the file is a valid .zst stream. Archives are read back as whole files, each by its own dictionary.

The dictionary is trained on at most TRAIN_ROWS records, spread by digest, of distinct payloads of at most TRAIN_BYTES
bytes each; with too few of them their bytes are the dictionary. It only changes sizes, never content.

Null html is an empty payload, an empty table gives no archive. Of equal payloads of at least MIN_REVISIT bytes the smallest page_id is the response.
Rows that repeat this page_id are responses too; rows with a null page_id are revisits unless all
of the group are null. A record's lengths and digests are those of the full payload; line breaks of a url are percent-encoded.
Columns other than page_id, url and html are not archived.
"""

from __future__ import annotations

import hashlib
import struct as bits
import uuid

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import PARTS, named_path, table, written

MIN_REVISIT = 100
TRAIN_ROWS = 500
TRAIN_BYTES = 1 << 16
DICT_BYTES = 1 << 16
ARCHIVE_BYTES = 64 << 20
#: Repeated digests are broadcast up to so many (some 100 bytes each).
BROADCAST_DIGESTS = 100_000
# Magic numbers of the dictionary frame and of any skippable frame; an empty one of these parts the frames.
DICTIONARY, SKIPPABLE = 0x184D2A5D, 0x184D2A50
BETWEEN = "P*M\x18\0\0\0\0"
EPOCH = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if len(raw) >= 8 else {}


def head_frame(raw: bytes) -> bytes:
    return bits.pack("<II", DICTIONARY, len(raw)) + raw


def record(name: str, kind: str, page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit carries no payload. ``name`` tells records apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>", f"WARC-Date: {EPOCH}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload; the payload's full length, which a revisit does not hold, is added as ``length``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    fields["length"] = http.decode().split("Content-Length: ", 1)[1].split("\r\n")[0]
    return fields, payload


def read_archive(data: bytes):
    """Records (headers, payload) of the bytes of one archive; needs nothing but the file."""
    at, z, view = 0, zstandard.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        magic, size = bits.unpack_from("<II", data, at)
        if magic & ~15 == SKIPPABLE:
            if magic == DICTIONARY:
                z = zstandard.ZstdDecompressor(**_dictionary(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        frame, out = z.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + (1 << 16)]
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield parse(b"".join(out))


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def repeats(pages: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(page_id, digest, size) of every page, (digest, first, n) of the repeated payloads, and the number of pages."""
    slim = pages.select("page_id", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("long").alias("size"))
    slim = written(slim, "digests")
    long_ = slim.where(F.col("size") >= MIN_REVISIT)
    first = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return slim, written(first, "repeats"), slim.count()


def marked(pages: DataFrame, first: DataFrame, rows: int) -> DataFrame:
    """(page_id, url, payload, digest, size, kind, refers_to); few or hot digests are broadcast, others joined."""
    p = pages.select("page_id", "url", _payload().alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    if first.count() <= BROADCAST_DIGESTS:
        p = p.join(F.broadcast(first), "digest", "left")
    else:
        hot = F.broadcast(first.where(F.col("n") > max(1, rows // PARTS)))  # fewer than PARTS, as n sums to the rows
        cold = first.where(F.col("n") <= max(1, rows // PARTS))
        p = p.join(hot, "digest").unionByName(p.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))


def samples(pages: DataFrame, slim: DataFrame, rows: int) -> list[bytes]:
    """Records for the dictionary. Digests below a cut that some four times TRAIN_ROWS rows pass come to the driver, then the first of their pages."""
    cut = min(1 << 52, (4 * TRAIN_ROWS << 52) // max(rows, 1))
    low = F.conv(F.substring("digest", 1, 13), 16, 10).cast("long") < cut
    few = slim.where(low & F.col("size").between(1, TRAIN_BYTES) & F.col("page_id").isNotNull())
    few = few.groupBy("digest").agg(F.min("page_id").alias("page_id")).orderBy("digest").limit(TRAIN_ROWS)
    ids = written(few.select("page_id").distinct(), "samples")  # TRAIN_ROWS rows at most
    found = pages.select("page_id", "url", _payload().alias("payload")).where(F.octet_length("payload") <= TRAIN_BYTES).join(F.broadcast(ids), "page_id")
    found = found.groupBy("page_id").agg(F.min(F.struct("payload", "url")).alias("p"))
    out = []
    for r in sorted(found.collect(), key=lambda r: r["page_id"]):
        body = bytes(r["p"]["payload"])
        out.append(record(str(r["page_id"]), "response", r["page_id"], r["p"]["url"], body, hashlib.sha256(body).hexdigest(), len(body), None))
    return out


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write the archives below ``path`` (a new one in the shared folder) and return it."""
    spark = pages.sparkSession
    path = path or named_path(spark, "warc")
    slim, first, rows = repeats(pages)
    sent = spark.sparkContext.broadcast(train(samples(pages, slim, rows)))

    def pack(batches):
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=3, **_dictionary(sent.value))
        archive, seq, filled = TaskContext.get().partitionId() << 20, 0, 0
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if filled >= ARCHIVE_BYTES:
                    archive, seq, filled = archive + 1, 0, 0
                if not seq:
                    out.append((archive, seq, head_frame(sent.value)))
                seq += 1
                page, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                frame = z.compress(record(f"{archive}:{seq}", r.kind, page, r.url, r.payload, r.digest, r.size, refers))
                filled += len(frame)
                out.append((archive, seq, frame))
            yield pd.DataFrame(out, columns=["archive", "seq", "frame"])

    cols = marked(pages, first, rows).select("page_id", "url", "payload", "digest", "size", "kind", "refers_to")
    # Nullable integers lose nothing as strings on their way through pandas.
    cols = cols.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    frames = cols.mapInPandas(pack, "archive long, seq long, frame binary").sortWithinPartitions("archive", "seq")
    frames.select("archive", F.col("frame").cast("string")).write.partitionBy("archive").option("lineSep", BETWEEN).text(path)
    return path


def name_archives(spark: SparkSession, path: str) -> None:
    """Rename the archives below ``path`` to <number>.warc.zst; one metadata operation a file, on the driver."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/archive=*/part-*")):
        own = f.getPath()
        number = own.getParent().getName().split("=")[1]
        fs.rename(own, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number}.warc.zst"))
        fs.delete(own.getParent(), True)


FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: ids, type, digest and size; those of responses are taken anew."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").load(path)

    def unpack(batches):
        for b in batches:
            for data in b["content"]:
                rows = []
                for h, body in read_archive(data):
                    kind, size, digest = h["WARC-Type"], int(h["length"]), h["WARC-Payload-Digest"][7:]
                    if kind == "response":
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    rows.append((h.get("X-Page-ID"), size, digest, kind, h.get("X-Refers-To-Page-ID")))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in FIELDS.split(", ")])
                        rows = []
                yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in FIELDS.split(", ")])

    out = files.select("content").mapInPandas(unpack, FIELDS)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(table(spark, sf_dir, "pages")))


OP7_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

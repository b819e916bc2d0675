"""ISO media containers: store payloads as raw samples, walk boxes, decode sample tables.

``mux`` stores bytes losslessly as 8-bit samples of 576 bytes each in an ISO
base media file; ``probe`` walks the nested boxes of any such file and reads of every track its handler, codec, duration and
the byte ranges of keyframes from the sample tables, and from the runs of movie fragments, without touching the payload.

Null texts count as empty. A payload always has at least one sample. A
damaged file gives a result with an ``error`` instead of a failed task. Repeated rows give repeated results, an empty table none. Extra columns
stay in ``probe_column``; one named ``media_info`` is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import TYPES, table, written
from quern.llm.common import struct as fields

SAMPLE = 576
RATE = 48000
#: Boxes whose content is a list of boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
TRACK = fields("track_id long, handler string, codec string, timescale long, duration long, n_samples long, n_keyframes long")
TRACK.add("ranges", T.ArrayType(fields("at long, size long")))
PROBE = T.StructType([T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("error", TYPES["string"])])


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of SAMPLE."""
    return data + b"\xff" * (-len(data) % SAMPLE if data else SAMPLE)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    if n < 1 << 32:
        return struct.pack(">I4s", n, kind) + body
    return struct.pack(">I4sQ", 1, kind, n + 8) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """One audio track of unsigned 8-bit samples ('raw '), one chunk; ``payload`` is a multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))

    def moov(at: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64", struct.pack(">IQ", 1, at)),
        )
        dref = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", dref), stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * SAMPLE & 0xFFFFFFFF, 0x55C4, 0))
        hdlr = _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"payload\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * SAMPLE & 0xFFFFFFFF), b"\0" * 8, struct.pack(">4h", 0, 0, 0x100, 0), MATRIX, b"\0" * 8, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n * SAMPLE & 0xFFFFFFFF, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    at = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(at) + _box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int):
    """(kind, start of content, end) of the boxes in [at, end)."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        yield bytes(kind), at + head, at + size
        at += size


def _ints(data, at: int, n: int, form: str = "I") -> tuple:
    return struct.unpack_from(f">{n}{form}", data, at)


def _walk(data: memoryview, at: int, end: int, above: tuple = ()):
    """(path of kinds, start of content, end, starts of the boxes around) of all boxes, in file order, without recursion."""
    todo = [boxes(data, at, end)]
    path: list[tuple[bytes, int]] = []
    while todo:
        for kind, a, b in todo[-1]:
            yield tuple(k for k, _ in path) + (kind,), a, b, tuple(x for _, x in path)
            if kind in NESTED:
                path.append((kind, a))
                todo.append(boxes(data, a, b))
                break
        else:
            todo.pop()
            if path:
                path.pop()


def tables(data: memoryview) -> tuple[dict[int, dict], dict[int, tuple], list[dict]]:
    """Per ``trak`` its boxes (kind -> start), defaults of fragments by track, and the fragments' ``traf`` boxes in file order."""
    traks: dict[int, dict] = {}
    defaults: dict[int, tuple] = {}
    frags: dict[int, dict] = {}
    for path, a, _, around in _walk(data, 0, len(data)):
        if path == (b"moov", b"mvex", b"trex"):
            defaults[_ints(data, a + 4, 1)[0]] = _ints(data, a + 8, 4)[1:]  # duration, size, flags
        elif path[:2] == (b"moov", b"trak") and len(path) > 2:
            traks.setdefault(around[1], {})[path[-1]] = a
        elif path[:2] == (b"moof", b"traf") and len(path) > 2:
            frag = frags.setdefault(around[1], {"moof": around[0] - 8, "trun": []})
            if path[-1] == b"trun":
                frag["trun"].append(a)
            else:
                frag[path[-1]] = a
    return traks, defaults, list(frags.values())


def _sizes(data, t: dict) -> list[int]:
    if b"stz2" in t:
        a = t[b"stz2"]
        bits, n = data[a + 7], _ints(data, a + 8, 1)[0]
        if bits == 4:
            return [data[a + 12 + k // 2] >> (0 if k % 2 else 4) & 15 for k in range(n)]
        return list(_ints(data, a + 12, n, {8: "B", 16: "H"}[bits]))
    a = t[b"stsz"]
    fixed, n = _ints(data, a + 4, 2)
    return [fixed] * n if fixed else list(_ints(data, a + 12, n))


def sample_ranges(data: memoryview, t: dict) -> tuple[list[tuple[int, int]], list[bool]]:
    """Byte range of every sample, and whether it is a keyframe (all are where there is no stss)."""
    sizes = _sizes(data, t)
    wide = b"co64" in t
    a = t[b"co64" if wide else b"stco"]
    chunks = _ints(data, a + 8, _ints(data, a + 4, 1)[0], "Q" if wide else "I")
    a = t[b"stsc"]
    runs = [_ints(data, a + 8 + 12 * k, 3) for k in range(_ints(data, a + 4, 1)[0])]
    out, s = [], 0
    for k, (first, per, _) in enumerate(runs):
        for c in range(first - 1, runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)):
            at = chunks[c]
            for size in sizes[s : s + per]:
                out.append((at, size))
                at += size
            s += per
    if b"stss" in t:
        a = t[b"stss"]
        key = set(_ints(data, a + 8, _ints(data, a + 4, 1)[0]))
        return out, [k + 1 in key for k in range(len(out))]
    return out, [True] * len(out)


#: Flag of a fragment's sample that is no keyframe.
NOT_SYNC = 0x10000


def fragment_ranges(data, frag: dict, defaults: dict[int, tuple], end: int) -> tuple[int, list, list, int, int]:
    """Track, byte ranges, keyframe marks, duration and end of the data of one ``traf``; ``end`` is where the one before ended."""
    a = frag[b"tfhd"]
    flags, track = _ints(data, a, 2)
    flags &= 0xFFFFFF
    duration, size, mark = defaults.get(track, (0, 0, 0))
    at, base = a + 8, frag["moof"] if flags & 0x20000 or end < 0 else end
    if flags & 1:
        base, at = _ints(data, at, 1, "Q")[0], at + 8
    at += 4 if flags & 2 else 0
    if flags & 8:
        duration, at = _ints(data, at, 1)[0], at + 4
    if flags & 16:
        size, at = _ints(data, at, 1)[0], at + 4
    if flags & 32:
        mark = _ints(data, at, 1)[0]
    out, key, total, now = [], [], 0, base
    for a in frag["trun"]:
        flags, n = _ints(data, a, 2)
        flags &= 0xFFFFFF
        at, first = a + 8, None
        if flags & 1:
            now, at = base + _ints(data, at, 1, "i")[0], at + 4
        if flags & 4:
            first, at = _ints(data, at, 1)[0], at + 4
        for k in range(n):
            d, z, m = duration, size, first if first is not None and not k else mark
            if flags & 0x100:
                d, at = _ints(data, at, 1)[0], at + 4
            if flags & 0x200:
                z, at = _ints(data, at, 1)[0], at + 4
            if flags & 0x400:
                m, at = _ints(data, at, 1)[0], at + 4
            at += 4 if flags & 0x800 else 0
            out.append((now, z))
            key.append(not m & NOT_SYNC)
            total += d
            now += z
    return track, out, key, total, now


def _joined(samples: list[tuple[int, int]], key: list[bool]) -> list[dict]:
    """Byte ranges of the keyframes; touching ones become one."""
    ranges: list[list[int]] = []
    for (at, size), k in zip(samples, key):
        if k and ranges and sum(ranges[-1]) == at:
            ranges[-1][1] += size
        elif k:
            ranges.append([at, size])
    return [{"at": a, "size": s} for a, s in ranges]


def probe(media: bytes | None) -> dict:
    """Every track's handler, codec, timescale, duration, samples and joined byte ranges of its keyframes; or the error met."""
    try:
        data = memoryview(media or b"")
        traks, defaults, frags = tables(data)
        if not traks:
            return {"tracks": [], "error": "no track"}
        more: dict[int, list] = {}
        end = -1
        for k, frag in enumerate(frags):
            if k and frag["moof"] != frags[k - 1]["moof"]:
                end = -1
            track, samples, key, total, end = fragment_ranges(data, frag, defaults, end)
            more.setdefault(track, []).append((samples, key, total))
        out = []
        for t in traks.values():
            a = t[b"tkhd"]
            number = _ints(data, a + (20 if data[a] == 1 else 12), 1)[0]
            handler = bytes(data[t[b"hdlr"] + 8 : t[b"hdlr"] + 12]).decode("latin-1")
            codec = bytes(data[t[b"stsd"] + 12 : t[b"stsd"] + 16]).decode("latin-1")
            a = t[b"mdhd"]
            scale = _ints(data, a + (20 if data[a] == 1 else 12), 1)[0]
            a = t[b"stts"]
            pairs = [_ints(data, a + 8 + 8 * k, 2) for k in range(_ints(data, a + 4, 1)[0])]
            samples, key = sample_ranges(data, t)
            duration = sum(n * d for n, d in pairs)
            for s, k, d in more.get(number, ()):
                samples, key, duration = samples + s, key + k, duration + d
            if any(at + size > len(data) for at, size in samples):
                raise ValueError(f"track {number} has samples beyond the end")
            out.append({
                "track_id": number, "handler": handler, "codec": codec, "timescale": scale, "duration": duration, "n_samples": len(samples),
                "n_keyframes": sum(key), "ranges": _joined(samples, key),
            })
        return {"tracks": out, "error": None}
    except (struct.error, ValueError, KeyError, IndexError) as e:
        return {"tracks": [], "error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(fields("n_bytes long, media binary"))
def _mux(texts: pd.Series) -> pd.DataFrame:
    raw = [(t or "").encode("utf-8") for t in texts]
    return pd.DataFrame({"n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]})


@F.pandas_udf(PROBE)
def _probe(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probe(m) for m in media], columns=PROBE.names)


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: bytes | None) -> tuple:
    """The payload that the first track's samples hold, read back, and what the boxes tell; a damaged file has no payload and its error as feature."""
    m, p = media or b"", probe(media)
    own = (len(m), hashlib.sha256(m).hexdigest())
    if p["error"]:
        return None, None, None, *own, f"error={p['error']}"
    t = p["tracks"][0]
    data = b"".join(m[r["at"] : r["at"] + r["size"]] for r in t["ranges"])
    spans = ";".join(f"{r['at']}+{r['size']}" for r in t["ranges"])
    feature = f"codec={t['codec'].strip()} rate={t['timescale']} duration={t['duration']} samples={t['n_samples']} keyframes={t['n_keyframes']} ranges={spans}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), *own, feature


@F.pandas_udf(fields(DIGEST))
def _digest(media: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([digest(m) for m in media], columns=[f.split(" ")[0] for f in DIGEST.split(", ")])
    return out.astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row."""
    return docs.select(F.col(doc_id), _mux(F.col(text)).alias("m")).select(doc_id, "m.n_bytes", "m.media")


def probe_column(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``media_info`` for a binary column of any ISO media files."""
    return df.withColumn("media_info", _probe(F.col(media)))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(store(table(spark, sf_dir, "documents")), "media")
    return kept.select("doc_id", "n_bytes", _digest(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")

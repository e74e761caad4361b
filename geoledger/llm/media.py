"""ISO media containers: write documents as 8-bit tracks, walk boxes, read sample tables."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoledger.llm.common import materialize

#: Boxes that hold only other boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf"}
SAMPLE, PER_CHUNK, KEY_EVERY, TIMESCALE = 64, 32, 16, 8000


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % SAMPLE if data else SAMPLE)


def write_media(payload: bytes) -> bytes:
    """An ISO media file with one track of 8-bit samples, 64 to a sample-table entry.

    Every 16th entry is a sync sample. The payload (a positive multiple of 64 bytes) is stored
    as it is in mdat, chunk after chunk.
    """
    n = len(payload) // SAMPLE
    duration = n * SAMPLE
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if n % PER_CHUNK == 0 else [(1, PER_CHUNK), (chunks, n % PER_CHUNK)][chunks == 1 :]
    keys = range(1, n + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def moov(first: int) -> bytes:
        offsets = [first + i * PER_CHUNK * SAMPLE for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, TIMESCALE, duration, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = _box(b"tkhd", struct.pack(">IQQIIQ", 1 << 24 | 3, 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">IQQIQIH", 1 << 24, 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    start = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(start) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of every box's content, containers entered; a box cut short ends the walk."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        size = end - start if size == 0 else size
        if size < body - start or start + size > end:
            return
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from boxes(data, body, start + size, here)
        start += size


def _track(data: bytes, at: dict[str, tuple[int, int]]) -> dict | None:
    """Codec, duration and byte ranges of one track from its tables."""
    u32 = lambda name, skip=4: struct.unpack_from(">I", data, at[name][0] + skip)[0]
    if not {"mdhd", "stsd", "stts", "stsc"} <= at.keys() or not at.keys() & {"stsz", "stz2"} or not at.keys() & {"stco", "co64"}:
        return None
    a = at["mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    codec = data[at["stsd"][0] + 12 : at["stsd"][0] + 16].decode("latin-1") if u32("stsd") else ""
    if "stsz" in at:
        same, n = struct.unpack_from(">II", data, at["stsz"][0] + 4)
        if n > len(data):  # a damaged count
            return None
        sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at["stsz"][0] + 12))
    else:
        bits, n = data[at["stz2"][0] + 7], u32("stz2", 8)
        raw = data[at["stz2"][0] + 12 :]
        sizes = [raw[i] if bits == 8 else raw[i // 2] >> 4 * (1 - i % 2) & 15 if bits == 4 else raw[2 * i] << 8 | raw[2 * i + 1] for i in range(n)]
    kind, code = ("stco", "I") if "stco" in at else ("co64", "Q")
    offsets = struct.unpack_from(f">{u32(kind)}{code}", data, at[kind][0] + 8)
    runs = [struct.unpack_from(">II", data, at["stsc"][0] + 8 + 12 * i) for i in range(u32("stsc"))]
    ranges, i = [], 0
    for k, (first, per) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)
        for chunk in range(first - 1, last):
            where = offsets[chunk]
            for size in sizes[i : i + per]:
                ranges.append((where, size))
                where += size
            i += per
    keys = range(1, n + 1)
    if "stss" in at:
        keys = struct.unpack_from(f">{u32('stss')}I", data, at["stss"][0] + 8)
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": ranges, "keyframes": [ranges[k - 1] for k in keys if k <= len(ranges)]}


def parse_media(data: bytes | None) -> list[dict]:
    """The tracks of an ISO media file; null, empty, foreign or broken data gives no track."""
    tracks: list[dict[str, tuple[int, int]]] = []
    try:
        for path, a, b in boxes(data or b""):
            if path == "/moov/trak":
                tracks.append({})
            elif path.startswith("/moov/trak/") and tracks:
                tracks[-1].setdefault(path.rpartition("/")[2], (a, b))
        return [t for t in (_track(data, at) for at in tracks) if t]
    except (struct.error, IndexError):
        return []


def read_payload(data: bytes, track: dict) -> bytes:
    """A track's bytes in sample order; neighbouring ranges are copied as one."""
    out, start, end = [], None, None
    for a, n in track["samples"]:
        if start is None or a != end:
            if start is not None:
                out.append(data[start:end])
            start, end = a, a
        end += n
    if start is not None:
        out.append(data[start:end])
    return b"".join(out)


_TRACK = pa.list_(
    pa.struct(
        [
            ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
            ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ]
    )
)


def describe_media(df: DataFrame, media_col: str) -> DataFrame:
    """``(row, tracks)``: for each file in a binary column its tracks' codec, duration (in units of
    the timescale), number of samples and keyframe byte ranges. The payload is never decoded.

    ``row`` is a struct of all input columns. Null, empty, cut or foreign files have an empty list.
    """
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[media_col].alias("media"))

    def run(batches):
        for b in batches:
            found = [
                [{"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["samples"]), "keyframes": [{"start": a, "length": n} for a, n in t["keyframes"]]} for t in parse_media(x)]
                for x in b.column("media").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found, _TRACK)], ["row", "tracks"])

    tracks = "array<struct<codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,length:bigint>>>>"
    return packed.mapInArrow(run, packed.select("row", F.lit(None).cast(tracks).alias("tracks")).schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes, padded, as an ISO media file.

    Null text counts as empty; an empty text is 64 zero bytes. Repeated rows stay repeated.
    """

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [write_media(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _feature(track: dict) -> str:
    """Codec, duration, counts and a checksum over all keyframe ranges, as JSON."""
    keys = track["keyframes"]
    crc = zlib.crc32(b"".join(struct.pack(">QI", *k) for k in keys))
    seen = {"codec": track["codec"], "duration_s": round(track["duration"] / track["timescale"], 6), "samples": len(track["samples"]), "keyframes": len(keys), "first_key": list(keys[0]), "last_key": list(keys[-1]), "key_crc32": crc}
    return json.dumps(seen, separators=(",", ":"))


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Digests of the media files, which are written to the shared folder and read back from there
    through their sample tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = materialize(store_texts(docs), "media", "zstd")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, media in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                (track,) = parse_media(media)
                back = read_payload(media, track)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(track)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [b.schema.field(0).type, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, *[pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return stored.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

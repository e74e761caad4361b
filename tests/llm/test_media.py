"""The media query against digests recomputed from the texts."""

import hashlib
import zlib

import pytest

from geoledger.llm import media


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


@pytest.mark.parametrize("kind", ["odd rows", "whole table", "no rows"])
def test_op8_recomputed(spark, tmp_path, kind):
    sf = "/root/testdata/sf0.001" if kind == "whole table" else str(tmp_path)
    if kind != "whole table":
        rows = [(1, None, 5), (2, "", 5), (3, "a" * 64, 5), (4, "é" * 33, 5), (5, "x" * 300_001, 5), (6, "same", 5), (7, "same", 5), (7, "same", 5), (8, "\0 zero", 5), (9, "日本" * 1000, 5)]
        table = spark.createDataFrame(rows if kind == "odd rows" else [], "doc_id bigint, text string, n_bytes int")
        table.write.parquet(f"{sf}/documents.parquet")
    want = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=str)
    got = media.op8_media(spark, sf).collect()
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    recomputed = [(i, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in want]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(recomputed, key=str)
    stored = {}
    for r in got:
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature
        assert stored.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert len({v[1] for v in stored.values()}) == len(stored)

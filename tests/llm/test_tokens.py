"""Token ids and packing against the tokenizers library itself."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from geoledger.llm import huffman, packing
from geoledger.llm.tokens import TextEncoder, public_path, slices

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " \t\n", "a", "A b", "x " * 3000, "é　 z", "a  b\n\nc ", "<|endoftext|> q", "7" * 400, "a\x1cb c", "don't  x", "1234 \x01 z", "é, É. à1b2 ÿ", "a\x00b c", "\n", "a\nb", " x", "x ",
    "a_b-c(d)[e]`f`~{g}|h' 's", "'s't 12.5% <b> &amp; #x @y", "½ µ ª º × ÷ Àb", "ǅ İ ß ſ K", "word " * 50_000,
]


def rows_of(path):
    return duckdb.sql(f"select doc_id, text from '{path}/documents.parquet' order by doc_id").fetchall()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in rows], "doc_id bigint, text string, start string, part string")


def direct(name, texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path(name))
    return [np.array([*e.ids, end], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_random_texts(name, kind):
    chance, alphabet = random.Random(1), "abcXYZ 019.,;'<>\n\tàÉÿ×²_ 　́İ-"
    texts = [*ODD, *("".join(chance.choice(alphabet) for _ in range(chance.randint(1, 40))) for _ in range(3000))]
    encoder = TextEncoder(public_path(name), kind)
    for got, want in zip(encoder.encode(texts), direct(name, texts, 0), strict=True):
        assert list(got) == list(want[:-1])


def test_slices_cover_a_column():
    import pyarrow as pa

    column = pa.array(["x" * (3 << 20), None, "", "y" * (9 << 20), "z"] * 3)
    assert [x for _, part in slices(column) for x in part.to_pylist()] == column.to_pylist()
    assert [at for at, _ in slices(pa.array([], pa.string()))] == []


def brute_digests(rows):
    """In order of id, null ids first, repeated ids by checksum of the 16-bit ids."""
    ids = direct("word_bpe_49k.json", [t for _, t in rows], 1)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, zlib.crc32(ids[k].astype("<u2"))))
    out, start = [], 0
    for k in order:
        out.append((rows[k][0], start, len(ids[k]), zlib.crc32(ids[k])))
        start += len(ids[k])
    return out


def test_op9_is_the_tokenizer(spark):
    got = huffman.op9_token_ids(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_digests(rows_of(SF))


def test_op9_null_and_repeated_ids(spark):
    rows = [*enumerate(ODD), (None, "null id"), (None, "and one more"), (3, "a"), (3, "b c")]
    got = huffman.stored_digests(frame(spark, rows)).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_digests(rows)
    assert huffman.stored_digests(frame(spark, rows).where("false")).count() == 0


def test_width_follows_the_vocabulary():
    assert huffman.width_of(65_536) == "<u2" and huffman.width_of(65_537) == "<u4"


def packed_is_whole(got, rows):
    """Every id lies in exactly one piece with the tokenizer's values, and sequences are gapless."""
    want = {}
    for (i, _), x in zip(rows, direct("byte_bpe_50k.json", [t for _, t in rows], 0), strict=True):
        want.setdefault(i, []).append(x)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for i, texts in want.items():
        left = sorted(pieces[i])
        expected = sorted((a, n, zlib.crc32(x[a : a + n]), len(x)) for x in texts for a, n in {(a, n) for a, n, _, m in left if m == len(x)} if len(texts) == 1)
        if len(texts) == 1:
            assert left == expected and sum(n for _, n, _, _ in left) == len(texts[0])
            assert [a for a, *_ in left] == [0, *np.cumsum([n for _, n, _, _ in left])[:-1]]
        else:
            assert sum(n for _, n, _, _ in left) == sum(map(len, texts))
    short = 0
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]]
        used = sum(n for _, n in s)
        assert used <= 1024
        short += 1024 - used if used & (used - 1) else 0
    return short


def test_op7_is_the_tokenizer(spark):
    rows = rows_of(SF)
    got = packing.op7_packing(spark, SF).collect()
    total = sum(r.length for r in got)
    assert packed_is_whole(got, rows) < 0.01 * total + 1024


def test_op7_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "null id"), (3, "a"), (3, "b c")]
    packed_is_whole(packing.pack_documents(frame(spark, rows)).collect(), rows)
    assert packing.pack_documents(frame(spark, rows).where("false")).count() == 0

"""Token ids in canonical length-limited Huffman blocks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.llm.common import materialize, scratch_path
from geoledger.llm.tokens import public_path, slices, text_encoder

#: Longest code, ids from one bit-offset checkpoint to the next, and ids to a block.
LIMIT, EVERY, BLOCK = 18, 256, 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    n, levels, merged = len(used), [], weight
    single = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(single)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        merged, single = both[order], order < n
    levels.append(single)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(levels):
        leaves = int(single[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for k in order:
        code <<= int(lengths[k]) - last
        codes[k], last = code, int(lengths[k])
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every possible next ``width`` bits."""
    width = max(int(lengths.max(initial=1)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = (1 << (width - lengths[order].astype(np.int64))).astype(np.int64)
    ids, size = np.zeros(1 << width, np.int32), np.ones(1 << width, np.int64)
    fill = int(span.sum())
    ids[:fill] = np.repeat(order, span)
    size[:fill] = np.repeat(lengths[order], span)
    return ids, size, width


def encode_documents(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """For documents of these ``counts``, one after another in ``ids``: the bits of each, filled up
    to whole bytes, and the bit offsets in it of its ids 0, EVERY, 2 * EVERY, ..."""
    counts = np.asarray(counts, np.int64)
    size = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(counts)
    first = last - counts
    n_bytes = end[last] - end[first] + 7 >> 3
    start = np.cumsum(n_bytes) - n_bytes
    inside = end[:-1] - np.repeat(end[first], counts)
    at = inside + np.repeat(8 * start, counts)
    out = np.zeros(int(n_bytes.sum()) + 4, np.uint8)
    if len(ids):
        where = at >> 3
        bits = codes[ids].astype(np.uint32) << (32 - size - (at & 7)).astype(np.uint32)
        new = np.flatnonzero(np.diff(where, prepend=-1))
        word, place = np.bitwise_or.reduceat(bits, new), where[new]
        for k in range(4):
            out[place + k] |= (word >> np.uint32(24 - 8 * k)).astype(np.uint8)
    raw = out.tobytes()
    return [raw[i : i + n] for i, n in zip(start, n_bytes, strict=True)], [inside[i:j:EVERY] for i, j in zip(first, last, strict=True)]


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits and checkpoints of one row of ids."""
    (raw,), (marks,) = encode_documents(ids, [len(ids)], codes, lengths)
    return raw, marks


def decode(data: bytes, marks: np.ndarray, counts: list[int], table: tuple) -> list[np.ndarray]:
    """The ids of documents of these ``counts`` whose checkpoints are ``marks``, one after another.

    All stretches between checkpoints are decoded in step, by one table look-up per id.
    """
    ids, size, width = table
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    left = np.concatenate([np.minimum(n - np.arange(0, n, EVERY), EVERY) for n in counts] or [np.zeros(0, np.int64)])
    out = np.zeros((len(left), EVERY), np.int32)
    order = np.argsort(-left, kind="stable")
    at = marks[order]
    live = len(at) - np.searchsorted(left[order][::-1], np.arange(EVERY), side="right")
    for step in range(int(left.max(initial=0))):
        here = at[: live[step]]
        code = (words[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[order[: len(here)], step] = ids[code]
        at[: len(here)] += size[code]
    return np.split(out[np.arange(EVERY) < left[:, None]], np.cumsum(counts)[:-1])


def width_of(vocabulary: int) -> str:
    """How raw ids are held: little-endian unsigned 16-bit where all ids fit, else 32-bit."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str, width: str = "<u4") -> DataFrame:
    """``(doc_id, tie, ids)``: the ids of each whole text and then ``end_id``, as numbers of type ``width``."""

    def run(batches):
        encoder, end = text_encoder(public_path(tokenizer), kind), np.array([end_id], width).tobytes()
        for batch in batches:
            keys = batch.column(0)
            for at, texts in slices(batch.column(1)):
                ids = [x.astype(width).tobytes() + end for x in encoder.encode(texts)]
                tie = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), tie, pa.array(ids, pa.binary())], ["doc_id", "tie", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tie bigint, ids binary")


def global_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: counted per task, summed by Spark; bounded by the vocabulary."""

    width = width_of(vocabulary)

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(i, 500).to_pylist()), width), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    kind: str = "words",
    end_id: int = 1,
    vocabulary: int = 49_408,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Tokenize ``docs`` and write their ids below ``path`` in ascending order of id.

    Two Parquet tables: ``codes`` (id, length), which fixes the canonical code, and ``blocks``
    (part, block, doc_ids, counts, checkpoints, payload). A block holds whole documents of about
    BLOCK ids, is decodable alone, and has the bit offset of every EVERY-th id of each document;
    documents begin at whole bytes. Null text counts as empty, null ids come first, rows that
    repeat an id stand in order of a checksum. An empty table writes empty tables.
    """
    spark, width = docs.sparkSession, width_of(vocabulary)
    each = np.dtype(width).itemsize
    tokens = materialize(tokenize(docs, tokenizer, kind, end_id, id_col, text_col, width), "token-ids", "zstd")
    lengths = code_lengths(global_counts(tokens, vocabulary))
    used = [(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    # raw ids are placed first, so that finding the ranges and the sort start no Python
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    placed = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def blocks(batches):
        codes = canonical_codes(lengths)
        rows, size, made, part = [], 0, 0, None
        names = ["part", "block", "doc_ids", "counts", "checkpoints", "payload"]

        def flush():
            n = np.array([len(x) for _, x in rows], np.int64) // each
            payload, marks = encode_documents(np.frombuffer(b"".join(x for _, x in rows), width), n, codes, lengths)
            start = np.cumsum([0, *map(len, payload)])[:-1]
            marks = np.concatenate([m + 8 * i for m, i in zip(marks, start, strict=True)])
            cols = [[part], [made], [[d for d, _ in rows]], [n], [marks], [b"".join(payload)]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                x = x.as_py()
                rows.append((doc, x))
                size += len(x) // each
                if size >= BLOCK:
                    yield flush()
                    rows, size, made = [], 0, made + 1
        if rows:
            yield flush()

    schema = "part int, block bigint, doc_ids array<bigint>, counts array<int>, checkpoints array<bigint>, payload binary"
    placed.select("doc_id", "ids", "part").mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, part, block, place, inside, n_tokens, ids)`` of all documents, decoded block by
    block; ``inside`` is how many ids stand before the document in its block. With ``digest`` the
    last column is ids_crc32 in place of the ids."""
    found = spark.read.parquet(f"{path}/codes").toArrow()  # at most the vocabulary
    lengths = np.zeros(int(found.column("id").to_numpy().max(initial=0)) + 1, np.uint8)
    lengths[found.column("id").to_numpy()] = found.column("length").to_numpy()
    names = ["doc_id", "part", "block", "place", "inside", "n_tokens", "ids_crc32" if digest else "ids"]

    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                b = batch.slice(i, 8)
                doc_ids, counts, marks, payload = (b.column(k).to_pylist() for k in ("doc_ids", "counts", "checkpoints", "payload"))
                each = [n for c in counts for n in c]
                base = np.cumsum([0, *map(len, payload)])[:-1]
                flat = np.concatenate([np.asarray(m, np.int64) + 8 * x for m, x in zip(marks, base, strict=True)])
                raw = [memoryview(x.astype("<u4")) for x in decode(b"".join(payload), flat, each, table)]
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array([x.tobytes() for x in raw], pa.binary())
                part, block = (np.repeat(b.column(k).to_numpy(), [len(c) for c in counts]) for k in ("part", "block"))
                place = np.concatenate([np.arange(len(c)) for c in counts])
                inside = np.concatenate([np.cumsum(c) - c for c in counts])
                cols = [pa.array([d for x in doc_ids for d in x], pa.int64()), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(place, pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(inside, pa.int64()), pa.array(each, pa.int64()), last], names)

    schema = "doc_id bigint, part int, block bigint, place int, inside bigint, n_tokens bigint, "
    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema + ("ids_crc32 bigint" if digest else "ids binary"))


def stored_digests(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the ids that ``write_ids`` wrote and ``read_ids`` read back.

    ``start`` counts the ids of all documents before in the order of the files: null ids first, then
    ascending; rows that repeat an id stand in order of a checksum. Starts are prefix sums on three levels: documents within a block where it is decoded,
    blocks within a part by a window sum, parts by a sum over one row per part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "huffman")
    write_ids(docs, path, **how)
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", F.expr("aggregate(counts, 0L, (a, n) -> a + n)").alias("n"))
    blocks = materialize(blocks, "huffman-blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "block", within.alias("block_start")).join(parts, "part")
    starts = starts.select("part", "block", (F.col("block_start") + F.col("part_start")).alias("base"))

    out = read_ids(spark, path, digest=True).join(starts, ["part", "block"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    return stored_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

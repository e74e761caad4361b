"""Hierarchical packing of tokenized documents into sequences of several context sizes."""

from __future__ import annotations

import bisect
import heapq
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geoledger.llm.tokens import public_path, slices, text_encoder

#: Context sizes, longest first.
TIERS = (1024, 512, 256, 128, 64)
#: Ids that are planned together in a task, or documents if those come first, and ids to a step group.
POOL, DOCS, STEP = 4_000_000, 65_536, 65_536
#: Bytes of texts that are encoded at once, and of pieces that an encoder remembers: a worker keeps both beside its pool.
SLICE, PIECES = 1 << 20, 100 << 20

#: (document, start in it, length)
Piece = tuple[int, int, int]


class _Shorts:
    """Rest pieces by length; takes the longest that fits, or cuts the longest there is."""

    def __init__(self, pieces: list[Piece]):
        self.items = sorted((n, -d, -a) for d, a, n in pieces)

    def __len__(self) -> int:
        return len(self.items)

    def longest(self) -> Piece:
        n, d, a = self.items.pop()
        return -d, -a, n

    def fill(self, gap: int, most: int) -> list[Piece]:
        """Pieces of at most ``most`` ids that fill ``gap`` exactly, or all there are."""
        out = []
        while gap and self.items and self.items[0][0] <= most:
            k = bisect.bisect_right(self.items, (min(gap, most), 1)) - 1
            if k >= 0:
                n, d, a = self.items.pop(k)
                out.append((-d, -a, n))
                gap -= n
                continue
            n, d, a = self.items.pop(0)
            out.append((-d, -a, gap))
            bisect.insort(self.items, (n - gap, d, a - gap))
            gap = 0
        return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces for documents of these lengths.

    Whole windows of the longest size are cut off a document's front. Its rest is routed to the
    smallest tier that holds it. Tiers are packed from long to short: the longest rest opens a
    window of its tier, and the gap is filled by rests of shorter tiers, the longest that fits
    first, the last one cut to fit; when there are no shorter ones, rests of the same tier serve.
    Only each pool's very last window can stay short.
    """
    top = tiers[0]
    out, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n // top * top
        out += [[(doc, a, top)] for a in range(0, whole, top)]
        if n > whole:
            rests.append((doc, whole, n - whole))
    shorts = _Shorts(rests)
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while len(shorts) and shorts.items[-1][0] > below:
            window = [shorts.longest()]
            gap = tier - window[0][2]
            window += shorts.fill(gap, below)
            gap = tier - sum(p[2] for p in window)
            window += shorts.fill(gap, tier)
            out.append(window)
    return out


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each sequence, so that groups have like numbers of ids: longest first, each to
    the group that has least."""
    n = max(1, -(-sum(sizes) // step))
    load = [(0, 0, g) for g in range(n)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, count, g = load[0]
        out[k] = g
        heapq.heapreplace(load, (total + sizes[k], count + 1, g))
    return out


def padded(used: int, tiers: tuple[int, ...] = TIERS) -> int:
    """A sequence is stored at its own length if that is a power of two, else at the longest size."""
    return used if used & (used - 1) == 0 else tiers[0]


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint, step_group bigint"


def pack_batches(batches, encoder, end_id: int, base: int, with_ids: bool):
    """Batches of pieces for one task's batches of (id, text); sequences and step groups are numbered from ``base``."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["ids"] * with_ids
    made = groups = 0

    def plan(ids: list[np.ndarray], keys: list):
        nonlocal made, groups
        sequences = pack([len(x) for x in ids])
        sizes = [sum(p[2] for p in s) for s in sequences]
        group = step_groups(sizes)

        def pieces():
            for k, s in enumerate(sequences):
                at = 0
                for d, a, n in s:
                    raw = ids[d][a : a + n].tobytes()
                    row = (keys[d], a, n, zlib.crc32(raw), len(ids[d]), base + made + k, at, padded(sizes[k]), base + groups + group[k])
                    yield (*row, raw) if with_ids else row
                    at += n

        rows = pieces()
        while some := list(islice(rows, 10_000)):
            cols = [pa.array(c, pa.binary() if k == 9 else pa.int64()) for k, c in enumerate(zip(*some, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names)
        made += len(sequences)
        groups += max(group, default=-1) + 1

    ids, keys, total = [], [], 0
    for batch in batches:
        some = batch.column(0).to_pylist()
        for i, texts in slices(batch.column(1), SLICE):
            for key, found in zip(some[i : i + len(texts)], encoder.encode(texts), strict=True):
                ids.append(np.append(found, end_id).astype("<u4"))
                keys.append(key)
                total += len(ids[-1])
            if total >= POOL or len(ids) >= DOCS:
                yield from plan(ids, keys)
                ids, keys, total = [], [], 0
    if ids:
        yield from plan(ids, keys)


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    kind: str = "spaced",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it starts there, and its place in a sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (stored
    length of the sequence), step_group, and ids (binary, little-endian unsigned 32-bit) if
    ``with_ids``. Every document is its text's ids and then ``end_id``; null text counts as empty,
    so it is the end id alone. Rows with a null or repeated id are documents of their own. An
    empty table gives no rows.

    Nothing is shuffled: every task tokenizes its rows and plans pools of about POOL ids, or DOCS
    documents if these are short, so memory is bounded by a pool, a SLICE or one document, and the
    remembered PIECES; one short sequence in a pool is the only padding. Sequence ids are unique through the task's partition number.
    """
    schema = _SCHEMA + (", ids binary" if with_ids else "")

    def run(batches):
        encoder = text_encoder(public_path(tokenizer), kind, PIECES)
        return pack_batches(batches, encoder, end_id, TaskContext.get().partitionId() << 36, with_ids)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

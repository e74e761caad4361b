"""A packing task's memory: bounded by its pool, slice and remembered pieces, whatever it reads."""

import os
import subprocess
import sys

import pyarrow as pa

from geoledger.llm import packing
from geoledger.llm.tokens import TextEncoder, public_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORKER = """
import resource
import numpy as np, pyarrow as pa
from geoledger.llm.packing import PIECES, pack_batches
from geoledger.llm.tokens import public_path, text_encoder

def batches():
    rng = np.random.default_rng(1)
    for k in range(6):
        letters = rng.integers(97, 123, (1000, 400, 7), np.uint8)
        letters[:, :, 6] = 32
        yield pa.RecordBatch.from_arrays([pa.array(range(1000 * k, 1000 * k + 1000), pa.int64()), pa.array([x.tobytes().decode() for x in letters])], ["doc_id", "text"])

encoder = text_encoder(public_path("byte_bpe_50k.json"), "spaced", PIECES)
rows = sum(1 for b in batches() for _ in b.column(1).to_pylist())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
docs = sum(sum(x == 0 for x in b.column(1).to_pylist()) for b in pack_batches(batches(), encoder, 0, 0, False))
assert docs == rows == 6000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_a_task_of_new_words_stays_small():
    """2.4 million different words in six batches; 163 MB more when measured, 301 with slices of 8 MB and pieces counted too low."""
    env = os.environ | {"PYTHONPATH": ROOT, "OMP_NUM_THREADS": "1"}
    grown = int(subprocess.run([sys.executable, "-c", WORKER], env=env, capture_output=True, text=True, check=True, timeout=300).stdout)
    assert grown < 230, grown


def test_a_pool_ends_at_many_short_documents():
    read = []

    def batches():
        for k in range(12):
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(range(10_000 * k, 10_000 * k + 10_000), pa.int64()), pa.array([None, ""] * 5000, pa.string())], ["doc_id", "text"])

    out = packing.pack_batches(batches(), TextEncoder(public_path("byte_bpe_50k.json"), "spaced"), 0, 0, False)
    first = next(out)
    assert len(read) == 7  # 70,000 documents of one id each, of 120,000
    found = [first, *out]
    assert len(read) == 12 and sorted(k for b in found for k in b.column(0).to_pylist()) == list(range(120_000))
    places = [x for b in found for x in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
    assert len(set(places)) == 120_000

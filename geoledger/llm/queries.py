"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from geoledger.llm import alignment, exact_dedup, huffman, licenses, media, minhash, mixing, negatives, ngram_join, packing, pii, toxicity, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": minhash.op3_near_dedup,
    "op4_urls": urls.op4_urls,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_media_columns": media.op8_media,
    "op9_token_ids": huffman.op9_token_ids,
    "op10_licenses": licenses.op10_licenses,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_alignment": alignment.op12_alignment,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}

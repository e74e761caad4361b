"""Toxicity scores against a plain cosine over whole vocabularies, and on held-out rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from geoledger.llm import toxicity

LABELS = "doc_id bigint, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "e") for i, t in rows], "doc_id bigint, text string, score double, evidence string")


def test_block_max_index_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "SPAN", 16)
    monkeypatch.setattr(toxicity, "QUERIES", 7)
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, (200, 30)) * (rng.random((200, 30)) < 0.2)
    dense = dense / np.maximum(np.sqrt((dense**2).sum(1)), 1e-300)[:, None]
    e, t = np.nonzero(dense)
    found, cosine = toxicity.BlockMaxIndex(e, t, dense[e, t], 200).search(e, t, dense[e, t], 200, 9)
    for q in range(200):
        dots = sorted((float(dense[q] @ dense[j]) for j in range(200)), reverse=True)
        want = [s for s in dots[:9] if s > 0]
        assert list(cosine[q][: len(want)]) == pytest.approx(want, abs=1e-9) and (found[q][len(want) :] == -1).all()
        assert [float(dense[q] @ dense[j]) for j in found[q][: len(want)]] == pytest.approx(want, abs=1e-9)


def brute(rows, labels):
    """Votes before calibration of every text, over all examples and terms, in plain Python."""
    bags = {i: Counter(re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", (t or "").lower()).split()) for i, t in rows}
    df = Counter(t for b in bags.values() for t in b)
    some = {i: y for i, y in labels if i in bags and zlib.crc32(str(i).encode()) % 5}
    prior = (sum(some.values()) + 0.5) / (len(some) + 1)
    used = {i: y for i, y in some.items() if zlib.crc32(str(i).encode()) % 5 != 4}
    share = sum(used.values()) / len(used)
    seen, with_1 = Counter(t for i in used for t in bags[i]), Counter(t for i, y in used.items() if y for t in bags[i])

    def weight(t):
        z = (with_1[t] - 0.5 - seen[t] * share) / math.sqrt(seen[t] * share * (1 - share))
        return math.log((1 + len(rows)) / (1 + df[t])) * (0.1 + max(z - 3, 0))

    def vector(b):
        v = {t: (1 + math.log(n)) * max(weight(t), 1e-9) for t, n in b.items() if t in seen}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples, out = {i: vector(bags[i]) for i in used}, {}
    for i, _ in rows:
        v = vector(bags[i])
        near = sorted((sum(x * u.get(t, 0.0) for t, x in v.items()) for u in examples.values()), reverse=True)[:15]
        out[i] = [x for x in near if x > 1e-10]
    return prior, out


def test_neighbours_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet' where toxic is not null").fetchall()
    docs = frame(spark, rows)
    got = toxicity.score_texts(docs, toxicity.labelled_model(docs, spark.createDataFrame(labels, LABELS))).collect()
    prior, want = brute(rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert [e.similarity for e in r.evidence] == pytest.approx(want[r.row.doc_id], abs=1e-6)
        if not r.evidence:
            assert r.score == pytest.approx(prior)


def test_op2_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, sf).toPandas().merge(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").df(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.98
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.01
    assert (got.evidence.str.len() > 0).mean() > 0.99


def test_odd_rows(spark):
    odd = [None, "", " \t\n", "a", "A", "x " * 30_000, "é　 z", "İ ß", "\x00 \x01"]
    rows = [*enumerate(odd), (None, "null id"), (3, "a"), (3, "a"), *((100 + k, f"you are a {'moron' if k % 4 == 0 else 'friend'} number {k}") for k in range(200))]
    labels = spark.createDataFrame([*((100 + k, int(k % 4 == 0)) for k in range(200)), (None, 1), (1, None), (7777, 1)], LABELS)
    docs = frame(spark, rows)
    got = toxicity.score_texts(docs, toxicity.labelled_model(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.row.text in ("a", "A")}) == 1 and all(r.evidence == [] for r in got if not (r.row.text or "").strip())
    assert {r.score >= 0.5 for r in got if "moron" in (r.row.text or "")} == {True} and {r.score >= 0.5 for r in got if "friend" in (r.row.text or "")} == {False}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 50
    assert toxicity.drop_toxic(docs.where("false"), labels).count() == 0
    for few in (labels.where("false"), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score_texts(docs, toxicity.labelled_model(docs, few)).collect()} == {(0.0 if few.isEmpty() else 0.5 / (few.join(docs.select("doc_id").distinct(), "doc_id").where(toxicity.fold(few["doc_id"]) != 0).count() + 1))}

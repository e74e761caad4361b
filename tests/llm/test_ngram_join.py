"""The exact n-gram join against all pairs."""

import random

import duckdb
import numpy as np
import pytest
from test_minhash import brute_groups

from geoledger.llm import ngram_join
from geoledger.llm.words import shingles


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_op11_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert got(ngram_join.op11_ngram_join(spark, sf)) == brute_groups(rows, 4, 85)


def small_rows(rng, n, most):
    """Short texts of few words, many of them alike."""
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, most))] for _ in range(n // 6)]
    out = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(40)}"
        out.append((k, " ".join(t[: rng.randint(max(1, len(t) - 2), len(t))])))
    return out


@pytest.mark.parametrize(("boundary", "shingle", "percent"), [(0, 1, 85), (9, 2, 70), (20, 1, 85)])
def test_small_sets_by_subsets_and_by_lists(spark, monkeypatch, boundary, shingle, percent):
    rows = small_rows(random.Random(boundary), 400, 24)
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *_: boundary)
    assert got(ngram_join.jaccard_classes(frame(spark, rows), shingle, percent)) == brute_groups(rows, shingle, percent)


def test_hot_passages_and_long_lists(spark, monkeypatch):
    """Texts that share a passage, chains of near copies, and a group of near copies, with short lists and parts."""
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "PART", 8)
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage, chain = [word() for _ in range(60)], [word() for _ in range(900)]
    rows = [(k, " ".join([word() for _ in range(rng.randint(1, 30))] + passage)) for k in range(120)]
    rows += [(200 + k, " ".join(chain[4 * k : 4 * k + 70])) for k in range(100)]
    rows += [(400 + k, " ".join([*chain[:200], *(word() for _ in range(rng.randint(0, 40)))])) for k in range(80)]
    assert got(ngram_join.jaccard_classes(frame(spark, rows))) == brute_groups(rows, 4, 85)


def test_no_rounds_leaves_all_to_the_scan(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "PART", 16)
    words = [f"w{k * 7919 % 10007}" for k in range(900)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 80])) for k in range(120)]
    assert got(ngram_join.jaccard_classes(frame(spark, rows))) == brute_groups(rows, 4, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One two  three"), (8, "one two three four five"), (None, "one"), (9, "é É"), (10, "É é"), (11, "x " * 5000)]
    found = got(ngram_join.jaccard_classes(frame(spark, rows)))
    assert found == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (2, 8), None: (1, None), 9: (1, 9), 10: (1, 10), 11: (1, 11)}
    assert got(ngram_join.jaccard_classes(frame(spark, []))) == {}
    twice = [(5, "b c d e"), (5, "a b c d"), (6, "a b c d"), (7, "b c d e"), (5, None)]
    assert sorted(tuple(r) for r in ngram_join.jaccard_classes(frame(spark, twice)).collect()) == [(5, 1, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 7)]
    df = spark.createDataFrame([(1, "a b c d", 9, "z"), (2, "a b c d", 8, "y")], "k bigint, body string, doc_id int, node string")
    assert got(ngram_join.jaccard_classes(df, id_col="k", text_col="body")) == {1: (1, 1), 2: (1, 1)}


def test_subsets_and_sketches_rule_no_link_out():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 24))
        a = np.sort(rng.choice(2**62, n, False).astype(np.uint64))
        b = np.sort(np.unique(np.concatenate([a[rng.random(n) < 0.93], rng.choice(2**62, int(rng.integers(0, 3))).astype(np.uint64)])))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 85 * (len(a) + len(b) - both)
        assert linked == (both >= ngram_join.needed(len(a), len(b), 85))
        keys = [set(zip(*(x.tolist() for x in ngram_join.subset_keys(s, 85)), strict=True)) for s in (a, b)]
        c = ngram_join.needed(len(a), len(b), 85)
        assert linked == any(k[0] == c for k in keys[0] & keys[1])
        assert ngram_join._apart(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(a) + len(b) - 2 * both
        if linked:
            p, q = (s[: ngram_join.prefix_length(len(s), 85)] for s in (a, b))
            assert len(np.intersect1d(p, q))
    big = shingles(rng.choice(2**62, 5000).astype(np.uint64), 1)
    assert ngram_join._apart(ngram_join.sketch(big), ngram_join.sketch(big[:4000])) <= 1000


def test_boundary_follows_the_cost():
    assert ngram_join.choose_boundary({}, 85) == ngram_join.SMALL
    assert ngram_join.choose_boundary({5: (10, 9)}, 85) == 4
    assert ngram_join.choose_boundary({5: (10, 90), 8: (10, 20), 12: (10, 10_000)}, 85) >= 12

"""Near-duplicate groups against all pairs by inverted shingles."""

from collections import Counter, defaultdict

import duckdb
import pytest

from geoledger.llm import minhash


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_groups(rows, size, percent=80):
    sets, holders = shingle_sets(rows, size), defaultdict(list)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holders[s])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_op3_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op3_near_dedup(spark, sf).collect()}
    assert got == brute_groups(rows, 2)


@pytest.mark.parametrize("step", [3, 7])
def test_chains_and_many_like_texts(spark, step):
    """Windows that slide over one long text: neighbours are linked, far ones are not."""
    words = [f"w{k * 7919 % 10007}" for k in range(900)]
    rows = [(k, " ".join(words[k * step : k * step + 60])) for k in range(100)]
    rows += [(1000 + k, " ".join([*words[:200], f"x{k}", f"y{k}"])) for k in range(300)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
    assert got == brute_groups(rows, 2)


def test_blocks_find_what_the_rounds_left(spark, monkeypatch):
    """With no rounds and small blocks all late links come from the blocks."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    words = [f"w{k * 7919 % 10007}" for k in range(900)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 60])) for k in range(120)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
    assert got == brute_groups(rows, 2)


def test_buckets_of_two_lose_no_link(spark):
    """Many chains of three texts: the middle one is linked to both ends, though it tries one centre only."""
    rows = []
    for c in range(400):
        w = [f"c{c}w{k}" for k in range(60)]
        rows += [(3 * c, " ".join(w[:51])), (3 * c + 1, " ".join(w[5:56])), (3 * c + 2, " ".join(w[10:]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()}
    assert got == brute_groups(rows, 2)

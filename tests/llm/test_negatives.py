"""Hard negatives against a plain reading of their definition."""

import math
import random

import pytest

from geoledger.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, scale=256):
    """Smallest (label, vector) of an id; whole-number products; ties by id."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        moved = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * x) for x in v])
        known[i] = min(known.get(i, moved), moved)
    out = []
    for a in sorted(k for k in known if k % 100 == 0):
        score = {k: sum(p * q for p, q in zip(known[a][1], v, strict=False)) for k, (_, v) in known.items()}
        order = sorted((k for k in known if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if known[k][0] == known[a][0]][:5]:
            found = [k for k in order if known[k][0] != known[a][0] and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            out += [(a, p, r, k, score[p], score[k]) for r, k in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def mined(df, **how):
    rows = negatives.vectors(df, **how)
    return negatives.hard_negatives(rows.where("id % 100 = 0"), rows)


def floats(rng, n):
    """Multiples of 1/16, which a float holds, so that scores tie."""
    return [rng.randint(-12, 20) / 16 for _ in range(n)]


@pytest.mark.parametrize(("anchors", "rows", "held"), [(4096, 8192, 1 << 20), (2, 40, 64)])
def test_ties_blocks_and_odd_rows(spark, monkeypatch, anchors, rows, held):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows), ("SCORES", held)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(8)
    table = [(k, floats(rng, 3), rng.randint(0, 3)) for k in range(0, 700)]
    table += [(k, [1.0, 0.5, 0.25], k % 2) for k in range(1000, 1060)]  # many equal vectors
    table += [(2000, None, 1), (2100, [1.0, None, 0.0], 1), (2200, [float("nan"), 0.0, 0.0], 1), (2300, [float("inf"), 0.0, 0.0], 1), (2400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    table += [(2500, [], 1), (2501, [1.0], 1), (2502, [1.0, 1.0, 1.0, 5.0], 2), (300, [2.0, 2.0, 2.0], 0), (300, [0.5, 0.5, 0.5], 0), (-100, [1.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(table, SCHEMA)
    assert got(mined(df)) == brute(table)


def test_empty_tables_and_clashing_columns(spark):
    assert got(mined(spark.createDataFrame([], SCHEMA))) == []
    assert got(mined(spark.createDataFrame([(100, [1.0, 1.0], 1)], SCHEMA))) == []
    df = spark.createDataFrame([(100, [1.0], 1, 9, "x"), (101, [1.0], 1, 9, "x"), (102, [0.9], 2, 9, "x")], "k bigint, v array<double>, c int, id int, label string")
    found = got(mined(df, id_col="k", vector_col="v", label_col="c"))
    assert found == [(100, 101, 1, 102, 65536, 256 * math.floor(256 * 0.9))]


def test_scores_beyond_doubles_are_whole_numbers(spark):
    big = [(100, [3.0e9, 1.0], 1), (101, [3.0e9, 2.0], 1), (102, [3.0e9, 1.0 + 2.0**-8], 2), (103, [2.6e9, 0.0], 2), (104, [-1.0e30, 0.0], 2)]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>, label int")
    top = 2**63 - 1
    want = [tuple(min(x, top) if c > 3 else x for c, x in enumerate(r)) for r in brute(big)]
    # scores that meet at the end of 64 bits tie, and then ids decide
    assert {r[:2] for r in got(mined(df))} == {r[:2] for r in want} and all(r[4] <= top for r in got(mined(df)))


def test_windows_hold_few_rows():
    """A positive behind negatives of its own score opens a window that has them; windows close below their end."""
    pairs = [((1, -100, 3), False), ((1, -100, 5), True), ((1, -90, 1), False), ((1, -90, 2), True), ((1, -80, 9), False), ((1, -72, 4), False), ((1, -71, 6), False), ((2, 5, 1), True), ((2, 6, 2), False)]
    assert list(negatives.windows(iter(pairs), 80, 5)) == [(1, 5, 1, 3, 100, 100), (1, 5, 2, 1, 100, 90), (1, 2, 1, 1, 90, 90), (1, 5, 3, 9, 100, 80), (1, 2, 2, 9, 90, 80), (1, 2, 3, 4, 90, 72)]
    assert [r[2:4] for r in negatives.windows(iter([((1, -9, 7), True), *(((1, -9, 10 + k), False) for k in range(9))]), 80, 5)] == [(k, 9 + k) for k in range(1, 6)]

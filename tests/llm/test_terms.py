"""Exact-dedup batches, URL segmentation and disclosing terms against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from geoledger.llm import exact_dedup, licenses, pii, urls


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id bigint, text string, source string, size bigint")


def test_batches_can_be_added_again(spark):
    index = exact_dedup.DigestIndex(spark)
    result = lambda rows, name: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.add_batch(frame(spark, rows), index, batch=name).collect())
    one, two, three = [(1, "a b"), (2, "ab"), (5, "z")], [(3, "a  b"), (4, "c")], [(6, "ab"), (7, "c")]
    first = result(one, "one")
    assert first == [(1, 1, 2, True), (2, 1, 2, False), (5, 5, 1, True)]
    assert result(one, "one") == first
    assert result(two, "two") == [(3, 1, 3, False), (4, 4, 1, True)]
    assert result(three, "three") == [(6, 1, 4, False), (7, 4, 2, False)]
    assert result(one, "one") == first and result(two, "two") == [(3, 1, 3, False), (4, 4, 1, True)]
    again = exact_dedup.DigestIndex(spark, index.name, buckets=3)
    assert again.buckets == index.buckets and sorted(again.batches()) == ["one", "three", "two"]
    with pytest.raises(ValueError):
        exact_dedup.add_batch(frame(spark, one), index, batch="a/b")
    index.drop()


def test_segments_are_the_best(spark):
    """Every split of short labels is scored; the operator's has the largest score."""
    chance = random.Random(2)
    known = {"".join(chance.choice("abc") for _ in range(chance.randint(1, 4))): chance.randint(1, 500) for _ in range(30)} | {"a" * 40: 9}
    labels = sorted({"".join(chance.choice("abcd") for _ in range(chance.randint(1, 9))) for _ in range(60)} | {"b" + "a" * 40})
    total = sum(known.values())

    def cost(parts, label):
        """A part counts as a known word, as the whole label that is new, or as single characters."""
        worth = 0.0
        for p in parts:
            options = [len(p) * (-math.log(total) - 12.0)]
            options += [math.log(known[p] / total)] if p in known else []
            options += [-12.0 - len(label)] if p == label else []
            worth += max(options)
        return worth

    unigrams = spark.createDataFrame([(w, n, 0) for w, n in known.items()], "word string, n bigint, own bigint")
    got = {r.label: r.words for r in urls.segmented(spark.createDataFrame([(x,) for x in labels], "label string"), unigrams).collect()}
    for label in labels:
        assert "".join(got[label]) == label
        if len(label) < 12:
            splits = ([label[a:b] for a, b in itertools.pairwise([0, *cuts, len(label)])] for n in range(len(label)) for cuts in itertools.combinations(range(1, len(label)), n))
            assert cost(got[label], label) == pytest.approx(max(cost(s, label) for s in splits))
    assert got["b" + "a" * 40][-1] == "a" * 40


def brute_terms(spans, texts):
    """Disclosing terms in plain Python from the base spans of all texts."""
    letters = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", t)}
    nt, nv, both, different = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in texts.items():
        words = letters(t)
        nt.update(words)
        entities = set()
        for kind, values in spans[i].items():
            for v in values:
                digits = re.sub("[^0-9]", "", v)
                entities |= {
                    "email": lambda v=v: {v.lower(), v.lower().split("@")[0], "@" + v.lower().split("@")[-1]}, "ip": lambda v=v: {v, v.rpartition(".")[0] + ".*"},
                    "card": lambda d=digits: {d, d[:6] + "*"}, "phone": lambda d=digits: {"+" + d},
                }[kind]()
        nv.update(entities)
        for e in entities:
            for w in words:
                both[e, w] += 1
                different[e, w].add(t)
    pairs = [k for k in both if len(different[k]) >= 3]
    out, n = set(), len(texts)
    for e, w in pairs:
        info, q, p = -math.log2(nv[e] / n), min(both[e, w] / nt[w], 1 - 1e-9), min(nv[e] / n, 1 - 1e-9)
        luck = len(different[e, w]) / q * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)))
        if info > 0 and (info + math.log2(both[e, w] / nt[w])) / info >= 0.9 and luck >= math.log(len(pairs) / 0.01):
            out.add(w)
    return out


def test_disclosing_terms_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    names = ["Zaphod", "Trillian", "Marvin", "Slartibart"]
    for k in range(160):
        who = names[k % 4]
        texts[10_000 + k] = f"{who if k % 3 else 'Nobody'} wrote line {'x' * (k % 9 + 4)} from {f'u{k}@{who.lower()}.org' if k % 3 else 'home'} and {f'10.{k % 4}.7.{k}' if k % 3 else 'there'}"
    base = pii.base_spans(frame(spark, list(texts.items())))
    spans = {r.row.doc_id: {k: [s.value for s in r[k]] for k in pii.PATTERNS} for r in base.collect()}
    got = {r.term for r in pii.disclosing_terms(base).collect()}
    want = brute_terms(spans, texts)
    assert got == want and {w.lower() for w in names} <= got


def test_templates_are_normalised(spark):
    rows = [(1, "It's the Owner's Own Software, isn't it?\nother"), (2, "nothing"), (3, "ÄRA software Kelvin")]
    got = {r.row.doc_id: r for r in licenses.scan_licenses(frame(spark, rows), templates={"o'wn\\": "IT'S the owner's own SOFTWARE", "none": " .,"}).collect()}
    assert [(m.label, m.containment) for m in got[1].matches] == [("o'wn\\", 1.0)] and got[2].matches == [] and got[3].n_words == 3

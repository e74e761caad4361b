"""Components of few edges in one partition, and of many by shuffles."""

import random

import pytest

from geoledger.operators import components


@pytest.mark.parametrize("few", [0, 50_000])
def test_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    chance = random.Random(5)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(None, 3), (7, 7)]
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(label.items())

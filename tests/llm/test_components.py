"""Connected components: rounds are taken only where links have more to say."""

import random

import pytest

from loamgraph.llm import components as module
from loamgraph.llm.components import components


@pytest.fixture
def writes(monkeypatch):
    names = []
    keep = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: (names.append(name), keep(df, name))[1])
    return names


def by_hand(links):
    own = {}
    for a, b in links:
        own.setdefault(a, a), own.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(own[a], own[b])
            changed |= own[a] != low or own[b] != low
            own[a] = own[b] = low
    return own


def found(df):
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_stars_take_no_round(spark, writes):
    links = [(1, 5), (6, 1), (-3, 9), (9, -3), (4, 4)]
    assert found(components(spark.createDataFrame(links, "a long, b long"))) == {1: 1, 5: 1, 6: 1, -3: -3, 9: -3}
    assert writes == ["links"]


@pytest.mark.parametrize("seed", range(3))
def test_known_components_grow(spark, writes, seed):
    rng = random.Random(seed)
    old = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    old = [(a, b) for a, b in old if a != b]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(12)]
    more = [(a, b) for a, b in more if a != b]
    known = components(spark.createDataFrame(old, "a long, b long"))
    assert found(known) == by_hand(old)
    assert found(components(spark.createDataFrame(more, "a long, b long"), known=known)) == by_hand(old + more)
    del writes[:]
    assert found(components(spark.createDataFrame(old[:5], "a long, b long"), known=known)) == by_hand(old)
    assert writes == ["links"]

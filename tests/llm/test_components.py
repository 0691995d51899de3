"""Components of links, against groups that are known."""

import random

import pytest

from graphquarry.llm import common


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch, few):
    """A chain of 300 nodes in random order, a hub, a pair and a self link: the smallest node of each, and tables by the logarithm of the chain."""
    made, put = [], common.materialize
    monkeypatch.setattr(common, "FEW_NODES", few, raising=False)
    monkeypatch.setattr(common, "materialize", lambda df, name="t": made.append(name) or put(df, name))
    rng = random.Random(3)
    chain, hub, pair = rng.sample(range(-(10**15), 0), 300), rng.sample(range(10**15), 50), [10**16, 10**16 + 1]
    links = [*zip(chain, chain[1:], strict=False), *[(hub[0], x) for x in hub[1:]], tuple(pair), tuple(pair[::-1]), (5, 5)]
    rng.shuffle(links)
    found = common.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    assert sorted((r["node"], r["component"]) for r in found) == sorted((x, min(g)) for g in (chain, hub, pair) for x in g)
    assert len(made) <= 2 * 14 + 2
    assert common.components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []

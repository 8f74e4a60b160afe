"""Closures of deep chains."""

import inspect

import pytest

from loomstar.operators import links


def test_closure_goes_on_or_raises(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(4)], "child long, parent long")
    roots = spark.createDataFrame([(0,)], "id long")
    assert inspect.signature(links.closure).parameters["rounds"].default is None
    assert {r["child"] for r in links.closure(edges, roots).collect()} == {1, 2, 3, 4}
    assert links.closure(edges, roots, rounds=3).count() == 4
    with pytest.raises(RuntimeError):
        links.closure(edges, roots, rounds=2)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """500 levels in about ten rounds; forks, rings, roots below roots and children of two parents."""
    cuts, cut = [], links.cut
    monkeypatch.setattr(links, "cut", lambda df, name: cuts.append(name) or cut(df, name))
    chain = [(i + 1, i) for i in range(500)]
    edges = spark.createDataFrame([*chain, (1000, 250), (2001, 2000), (2000, 2001), (3001, 3000), (500, 2)], "child long, parent long")
    got = {tuple(r) for r in links.closure(edges, spark.createDataFrame([(0,), (400,)], "id long")).collect()}
    assert got == {(i, 0 if i <= 400 else 400) for i in range(1, 500)} | {(1000, 0), (500, 0)}
    assert len(cuts) <= 12

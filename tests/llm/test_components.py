"""Components that haven't settled."""

import pytest

from loomstar.llm import neardup


def test_components_settle_or_raise(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {tuple(r) for r in neardup.components(links).collect()} == {(i, 0) for i in range(10)}
    with pytest.raises(RuntimeError):
        neardup.components(links, rounds=1)

"""The stated chance that the sketches of a pair at the threshold share too few values."""

from math import comb

from loomstar.llm import neardup


def test_stated_chance():
    chance = sum(comb(neardup.K, i) * 0.8**i * 0.2 ** (neardup.K - i) for i in range(neardup.LEAST))
    assert f"{chance:.1e}".replace("e-0", "e-") in neardup.__doc__

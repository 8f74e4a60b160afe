"""Joins of the rounds that depths take."""

from loomstar.operators import links


def test_no_table_of_depths_is_broadcast(spark, monkeypatch):
    """Tables that compress well look small by their files; a million rows of them must not go through the driver."""
    plans, cut = [], links.cut
    monkeypatch.setattr(links, "cut", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df, name))
    rows = [(g, i, f"{i}", f"{i - 1}" if i % 5 else f"{i // 2}" if i else None) for g in ("a", "b") for i in range(40)]
    nodes = spark.createDataFrame(rows, "g string, o int, n string, p string")
    found = links.depths(nodes, "g", "o", "n", "p")
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
    want = {}
    for g, i, _, p in rows:
        want[g, i] = want[g, int(p)] + 1 if p is not None and int(p) < i else 0
    assert {(r["g"], r["o"]): r["conversation_depth"] for r in found.collect()} == want


def test_a_plain_conversation_needs_no_join(spark):
    rows = [("a", i, None if i == 3 else f"{i}", f"{i - 1}" if i % 7 else None) for i in range(20)]
    found = links.depths(spark.createDataFrame(rows, "g string, o int, n string, p string"), "g", "o", "n", "p")
    assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [r["conversation_depth"] for r in found.orderBy("o").collect()] == [0, 1, 2, 3, 0, 1, 2, 0, 1, 2, 3, 4, 5, 6, 0, 1, 2, 3, 4, 5]

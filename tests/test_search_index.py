"""Posting lists give the rows of a plain search and read less."""

import random
import time

from loomstar.operators import conversation, search_index


def test_index_equals_scan(spark, tmp_path):
    rng, words = random.Random(3), ["alpha", "Beta", "ÉTÉ", "gam.ma", "x", "de", "alphabet", "日本語版"]
    rows = [(f"id{i % 50}", f"s{i % 9}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), "c") for i in range(400)] + [("z", "s1", "only here: needle", "c"), ("z", None, None, "c")]
    docs = spark.createDataFrame(rows, "id string, session_id string, content string, type string")
    folder = str(tmp_path / "index")
    search_index.write(docs, folder)
    for query in ("alpha", "BETA été", "needle", "x de", "", "lphabet gam.ma", "missing", "日本語", "alp phab"):
        want = sorted(map(str, conversation.search(docs, query, 10_000).collect()))
        assert sorted(map(str, search_index.search(spark, folder, query, 10_000).collect())) == want, query
        want = sorted(map(str, conversation.search(docs.where("session_id = 's3'"), query, 10_000).collect()))
        assert sorted(map(str, search_index.search(spark, folder, query, 10_000, session="s3").collect())) == want, query
    assert search_index.candidates(spark, folder, "x de") is None
    alone = search_index.search(spark, folder, "x", session="s3")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in alone.split("PartitionFilters: [")[1].split("]")[0]  # one part is read
    plan = search_index.search(spark, folder, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket#" in search_index.candidates(spark, folder, "needle")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_long_texts_are_indexed_in_one_pass(spark, tmp_path):
    """A text of 300,000 characters took work by their square."""
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(150_000)) + " End\N{GRINNING FACE}x?y"
    documents = spark.createDataFrame([("s", "1", text), ("t", "2", "ab"), ("t", "3", None)], "session_id string, id string, content string")
    began = time.monotonic()
    search_index.write(documents, str(tmp_path / "index"))
    assert time.monotonic() - began < 40
    grams = {r["gram"] for r in spark.read.parquet(str(tmp_path / "index" / "postings")).collect()}
    low = text.lower()
    assert {low[i : i + 3] for i in range(len(low) - 2)} <= grams and {len(g) for g in grams} == {3}
    assert [r["id"] for r in search_index.search(spark, str(tmp_path / "index"), "D\N{GRINNING FACE}X ?Y").collect()] == ["1"]

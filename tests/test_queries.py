"""The semantic model, the query builder, enrichment, streaming, and all queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomstar.operators import enrichment, semantic
from loomstar.plans import registry
from loomstar.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql_engine(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, sql_engine, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name not in registry.SQL:
        assert name == "semantic_model" and got
        return
    cur = sql_engine.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["tool_category", "usage_count", "avg_output_size"]
    assert set(registry.SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def tables(spark):
    return {
        "fact_x": spark.createDataFrame([("a", "k1", 1, True, 2.0), ("b", "k2", 2, False, 3.0), ("c", None, 3, True, None)], "x_id string, tool_key string, word_count int, is_error boolean, wait_seconds double"),
        "dim_tool": spark.createDataFrame([("k1", "T1"), ("k2", "T2")], "tool_key string, tool_name string"),
        "dim_lost": spark.createDataFrame([("z",)], "lost_name string"),
    }


def test_semantic_model(spark):
    rows = {(r["table_name"], r["column_name"]): r for r in semantic.semantic_model(spark, tables(spark)).collect()}
    assert rows["fact_x", "tool_key"]["related_table"] == "dim_tool" and not rows["fact_x", "tool_key"]["is_visible"] and rows["dim_tool", "tool_key"]["is_visible"]
    assert (rows["fact_x", "word_count"]["column_type"], rows["fact_x", "word_count"]["default_aggregation"]) == ("measure", "sum")
    assert rows["fact_x", "wait_seconds"]["default_aggregation"] == "avg" and rows["fact_x", "is_error"]["column_type"] == "measure"
    assert rows["dim_tool", "tool_name"]["column_type"] == "attribute" and rows["fact_x", "x_id"]["column_display_name"] == "X Id"
    assert rows["fact_x", "word_count"]["data_type"] == "integer" and semantic.data_type("string", "input_json") == "json"
    assert [semantic.aggregation(c) for c in ("max_depth", "q_score", "total_time", "x_chars")] == ["max", "avg", "sum", "sum"]
    assert len(semantic.MODEL.split(",")) == 13


def test_query_builder(spark):
    q = semantic.QueryBuilder(tables(spark), page_size=2).set_base_table("fact_x")
    q.add_column("fact_x", "x_id").add_column("dim_tool", "tool_name").add_column("fact_x", "x_id").add_column("dim_lost", "lost_name")
    assert [c[2] for c in q.columns] == ["x_id", "tool_name", "x_id_1", "lost_name"]
    assert q.rows().columns == ["x_id", "tool_name", "x_id_1"]  # a dimension without a relationship is left out
    q.toggle_sort("tool_name").toggle_sort("tool_name")
    assert [r["x_id"] for r in q.rows().collect()] == ["b", "a", "c"]
    assert q.count().first()["cnt"] == 3
    assert [r["x_id"] for r in q.set_page(9, 3).run().collect()] == ["c"]
    q.set_filter("tool_name", ["T1"])
    assert q.page == 0 and [r["x_id"] for r in q.run().collect()] == ["a"]
    assert q.clear_filters().toggle_sort("tool_name").sorts == []
    q.remove_column("tool_name")
    assert "Join" not in q.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert [r["val"] for r in q.distinct_values("dim_tool", "tool_name", "t2").collect()] == ["T2"]
    numbers = semantic.QueryBuilder(tables(spark)).set_base_table("fact_x").add_column("fact_x", "word_count").set_filter("word_count", ["3", "x"])
    assert numbers.count().first()["cnt"] == 1


def test_enrichment(spark):
    calls = []

    def answer(part):
        assert len(part) <= 2
        return [{"message_id": m["message_id"], "intent": "debug" if m["content_text"] == "x" else "nonsense", "topics": ["api", "zzz"]} for m in part]

    rows = spark.createDataFrame([(f"m{i}", "s", "x" if i % 2 else "y", "user") for i in range(5)], "message_id string, session_key string, content_text string, message_type string").coalesce(1)
    answers = enrichment.enrich_messages(rows, answer, 2)
    facts, topics = enrichment.enrichment_facts(answers, "m", ["debug", "question"], ["neutral"], ["api"])
    by = {r["message_id"]: r for r in facts.collect()}
    assert len(by) == 5 and by["m1"]["intent_key"] != by["m0"]["intent_key"] and by["m0"]["confidence_score"] == 0.5
    assert topics.count() == 5 and topics.first()["relevance_score"] == 1.0
    assert not calls


def test_stream(spark, tmp_path):
    import json

    from tests import fixtures as X

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"session_id": "s", "project_path": "p", "line_no": i, "line": json.dumps(e)} for i, e in enumerate(X.CHAIN)]
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    (folder / "b.json").write_text("\n".join(json.dumps(x) for x in lines[:4]))  # repeats
    entries = incremental.entries_stream(spark.readStream.schema(incremental.LINE).json(str(folder)))
    q = incremental.keep_table(entries, str(tmp_path / "kept"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 10
    counts = incremental.tool_counts(incremental.entries_stream(spark.readStream.schema(incremental.LINE).json(str(folder))))
    q = counts.writeStream.format("memory").queryName("tool_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tool_counts").where(F.col("n") > 1).count() == 0


def test_ledger_asks_once(spark, tmp_path):
    """Calls equal messages: over two tables, two runs, and a run after a failure."""
    log, rows = tmp_path / "asked", [(f"m{i:03d}", f"s{i % 3}", f"text {i}", "k") for i in range(100)]
    messages = spark.createDataFrame(rows, "message_id string, session_key string, content_text string, message_type_key string").repartition(5)
    kinds, path = spark.createDataFrame([("k", "user")], "message_type_key string, message_type string"), str(tmp_path / "ledger")

    def answer(part, fails=False):
        if fails and any(m["message_id"] == "m050" for m in part):
            raise ValueError("no answer")
        with open(log, "a") as f:
            f.writelines(f"{m['message_id']}\n" for m in part)
        return [{"message_id": m["message_id"], "topics": ["api"]} for m in part] + [{"intent": "debug"}]

    assert enrichment.enrich(path, messages, kinds, answer, "m", batch_size=4, limit=10) == 10
    assert sorted(log.read_text().split()) == [f"m{i:03d}" for i in range(10)]
    assert enrichment.enrich(path, messages, kinds, answer, "m", session_key="s1") == 30
    with pytest.raises(Exception, match="no answer"):
        enrichment.enrich(path, messages, kinds, lambda part: answer(part, True), "m", batch_size=1, per_round=10)
    written = enrichment.ledger(spark, path).count()
    assert 40 <= written < 100
    assert enrichment.enrich(path, messages, kinds, answer, "m2", per_round=10) == 100 - written
    facts, topics = enrichment.enrichment_facts(enrichment.ledger(spark, path), "", ["question"], ["neutral"], ["api"])
    assert facts.count() == topics.count() == facts.select("message_id").distinct().count() == 100
    before = len(log.read_text().split())
    assert enrichment.enrich(path, messages, kinds, answer, "m") == 0 and len(log.read_text().split()) == before
    log.unlink()  # answers that aren't a ledger's: two tables, one call a message
    rows_ = enrichment.enrich_messages(enrichment.pending(messages, enrichment.ledger(spark, str(tmp_path / "none")), kinds), answer, 10)
    facts, topics = enrichment.enrichment_facts(rows_, "m", ["question"], ["neutral"], ["api"])
    assert facts.count() == topics.count() == 100 and len(log.read_text().split()) == 100


def test_builder_of_a_database(spark, tmp_path):
    spark.range(5).selectExpr("id as a_key", "id * 2 as x_count").write.parquet(str(tmp_path / "f"))
    spark.range(3).selectExpr("id as a_key", "concat('n', id) as name").write.parquet(str(tmp_path / "d"))
    semantic.attach(spark, "loomstar_test", {"fact_x": str(tmp_path / "f"), "dim_a": str(tmp_path / "d")})
    try:
        for stored in (False, True):  # a missing model is tolerated
            if stored:
                semantic.save_model(spark, "loomstar_test")
                assert semantic.stored_model(spark, "loomstar_test").count() == 4
            q = semantic.QueryBuilder.of_database(spark, "loomstar_test").set_base_table("fact_x")
            assert set(q.tables) == {"fact_x", "dim_a"} and (q.model is not None) == stored and q.relationships() == {"dim_a": ("a_key", "a_key")}
            q.add_column("fact_x", "x_count").add_column("dim_a", "name")
            assert sorted(map(tuple, q.rows().collect()), key=str) == [(0, "n0"), (2, "n1"), (4, "n2"), (6, None), (8, None)]
        spark.sql("ALTER TABLE loomstar_test.meta_semantic_model RENAME TO loomstar_test.other")
        assert semantic.stored_model(spark, "loomstar_test") is None
        assert {(r["table_name"], r["column_name"]) for r in semantic.described(spark, "loomstar_test").where("table_name <> 'other'").collect()} == {("fact_x", "a_key"), ("fact_x", "x_count"), ("dim_a", "a_key"), ("dim_a", "name")}
    finally:
        spark.sql("DROP DATABASE loomstar_test CASCADE")


def test_seek_pages_equal_offset_pages(spark):
    rows = [(None if i % 7 == 0 else i % 5, None if i % 11 == 0 else "ab"[i % 2], float(i % 3)) for i in range(500)]
    for sort in ([], ["n"], ["n", "n"], ["t", "t"]):
        q = semantic.QueryBuilder({"fact_t": spark.createDataFrame(rows, "n int, t string, x double")}, page_size=30).set_base_table("fact_t")
        for c in ("n", "t", "x"):
            q.add_column("fact_t", c)
        for alias in sort:
            q.toggle_sort(alias)
        keys = [*q.sorts, *[(a, "asc") for a in ("n", "t", "x") if a not in dict(q.sorts)]]
        want = q.rows().orderBy(*[F.col(a).asc_nulls_last() if d == "asc" else F.col(a).desc_nulls_last() for a, d in keys]).collect()
        pages = list(q.walk())
        assert [len(p) for p in pages] == [30] * 16 + [20] and [r for p in pages for r in p] == want
    deep = q.page_after(pages[10][-1], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in deep and "rangepartitioning" not in deep

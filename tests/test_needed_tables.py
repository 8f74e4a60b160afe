"""Queries write only the tables that they need, and times are keyed alike by both ways."""

from pyspark.sql import functions as F

from loomstar.functions import columns as C
from loomstar.operators import links
from loomstar.operators.star import Star
from loomstar.plans import given_tables, registry
from loomstar.sources import transcripts


def written(monkeypatch, spark, sf_dir, *names):
    found, cut = [], links.cut
    record = lambda df, name: found.append(name) or cut(df, name)
    monkeypatch.setattr(links, "cut", record)
    monkeypatch.setattr(given_tables, "cut", record)
    monkeypatch.setattr(given_tables, "_stars", {})
    for name in names:
        registry.QUERIES[name](spark, sf_dir)
    return found


def test_simple_calls_and_sessions_need_no_texts_and_no_second_copy(spark, sf_dir, monkeypatch):
    assert sorted(written(monkeypatch, spark, sf_dir, "simple_tool_calls", "simple_sessions")) == ["blocks", "entries"]


def test_uses_of_blocks_and_errors_need_no_depths(spark, sf_dir, monkeypatch):
    found = written(monkeypatch, spark, sf_dir, "dim_content_block_type", "dim_error_type")
    assert "fact_content_blocks" in found and not {"fact_messages", "runs", "depths", "texts"} & set(found)


def test_usual_times_are_keyed_as_any_other(spark):
    texts = ["2024-02-29T23:59:07.123456Z", "2024-01-01T00:00:00+05:30", "2024-01-01T09:05:59", "2023-02-29T10:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01 10:11:12Z", "2024-01-01T10:11Z", "2024-01-01", "2024-01-01T7:08:09Z", "2024-01-01T10:11:12+0530", "2024-13-01T10:11:12Z", "x", ""]
    rows = spark.createDataFrame([(f"s{i}", i, t) for i, t in enumerate(texts)], "session_id string, line_no int, ts_text string")
    whole = rows.select("*", F.lit("user").alias("type"), F.lit("/p").alias("project_path"), transcripts.timestamp_of(F.col("ts_text")).alias("ts"), F.lit(True).alias("has_message"))
    wall, ok = transcripts.wall_clock(F.col("ts_text")), F.col("ts").isNotNull()
    got = Star(whole).keyed.select("line_no", "date_key", "time_key", F.when(ok, C.date_key(wall)).alias("d"), F.when(ok, C.time_key(wall)).alias("t")).collect()
    assert [(r.date_key, r.time_key) for r in got] == [(r.d, r.t) for r in got]
    assert sum(r.date_key is not None for r in got) >= 6

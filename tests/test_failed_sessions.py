"""Broken sessions are all written."""

from loomstar.sources import sinks, transcripts
from tests import fixtures


def test_all_broken_sessions_are_written(spark, tmp_path):
    for i in range(3):
        fixtures.write(tmp_path / "in" / "p", f"b{i}.jsonl", fixtures.BROKEN)
    told = sinks.write_failed(spark, transcripts.read_entries(spark, str(tmp_path / "in")), str(tmp_path / "out"), told=2)
    assert told["failed_count"] == 3 and told["failed_sessions"] == ["b0", "b1"]
    assert {r["session_id"] for r in spark.read.parquet(told["failed_path"]).collect()} == {"b0", "b1", "b2"}

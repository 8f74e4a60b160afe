"""Transcripts as a stream of lines, an extension to the batch readers.

Lines arrive as JSON with a session and a line number (appended files, or a queue). Repeats within the watermark are
dropped, tools are counted in event-time windows, and each micro-batch can replace its sessions in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstar.sources import sinks, transcripts

LINE = "session_id string, project_path string, line_no int, line string"


def entries_stream(lines: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Entries of a stream of lines (see LINE), each once."""
    rows = transcripts.parse_lines(lines).where(F.col("ts").isNotNull())
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session_id", "line_no"])


def tool_counts(entries: DataFrame, window: str = "1 hour") -> DataFrame:
    """Tool calls by tool and window of event time."""
    blocks = F.explode(F.from_json("content", "array<string>"))
    rows = entries.where("content_kind = 'array'").select("ts", blocks.alias("b")).where(F.get_json_object("b", "$.type") == "tool_use")
    counts = rows.groupBy(F.window("ts", window), F.get_json_object("b", "$.name").alias("tool_name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "tool_name", "n")


def keep_table(entries: DataFrame, folder: str, checkpoint: str):
    """A query that keeps a table of entries up to date; a batch that is done again changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        sinks.append_sessions(batch, folder, "session_id")

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

"""The simple schema: sessions, messages, tool_calls and thinking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions import fixed
from loomstar.functions.arrow import as_python_str
from loomstar.operators import links
from loomstar.operators.numbering import global_row_numbers
from loomstar.operators.star import Star
from loomstar.sources import transcripts


def sessions_of(star: Star) -> DataFrame:
    """The table of sessions; it needs the star's entries and blocks, no texts."""
    said = star.entries
    first = said.groupBy("session_id", "project_path").agg(F.min_by(F.struct("cwd", "git_branch", "version", "agent_id", "is_sidechain", "log_session_id"), "line_no").alias("m"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("started_at"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("ended_at"), F.count(F.lit(1)).cast("int").alias("message_count"), F.count_if(F.col("type") == "user").cast("int").alias("user_message_count"), F.count_if(F.col("type") == "assistant").cast("int").alias("assistant_message_count"))
    uses = star.blocks.where("type = 'tool_use'").groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("tool_use_count"))
    return first.join(uses, "session_id", "left").select("session_id", "project_path", F.element_at(F.split("project_path", "/"), -1).alias("project_name"), "m.cwd", "m.git_branch", "m.version", "started_at", "ended_at", "message_count", "user_message_count", "assistant_message_count", F.coalesce("tool_use_count", F.lit(0)).alias("tool_use_count"), F.col("m.agent_id").isNotNull().alias("is_agent"), "m.agent_id", F.when(F.col("m.agent_id").isNotNull(), F.col("m.log_session_id")).alias("parent_session_id"), "m.is_sidechain")


def messages_of(star: Star) -> DataFrame:
    return star.texts.select(F.col("uuid").alias("message_id"), "session_id", F.col("parent_uuid").alias("parent_id"), F.col("type").alias("role"), "model", F.col("ts").alias("timestamp"), F.substring("full_text", 1, star.truncate).alias("content"), F.col("content").alias("content_json"), "has_tool_use", "has_tool_result", "has_thinking", "is_sidechain")


def calls_of(star: Star, unresolved: bool = False, across_sessions: bool = False) -> DataFrame:
    """The table of tool calls; it needs the star's blocks alone."""
    keys = ["tool_use_id"] if across_sessions else ["session_id", "tool_use_id"]
    file_order = ["session_no"] if across_sessions else []  # of an export's conversations
    use = star.uses.select("session_id", *file_order, F.col("id").alias("tool_use_id"), "line_no", "block_idx", F.lit(True).alias("_is"), F.struct("session_id", "message_id", "tool_name", "input_json", "ts", "line_no", "block_idx").alias("_use"))
    output = F.col("full_output")
    if across_sessions:  # an import keeps what isn't a string as Python writes it
        other = F.col("result_kind") != "string"
        output = F.when(other, as_python_str(F.when(other, F.coalesce("result", F.lit("null"))))).otherwise(output)
    result = star.results.select("session_id", *file_order, "tool_use_id", "line_no", "block_idx", F.lit(False).alias("_is"), F.struct(output.alias("full_output"), "is_error", "ts").alias("_out"))
    order = [*file_order, "line_no", "block_idx"]
    rows = links.latest_before(use.unionByName(result, allowMissingColumns=True), keys, order, "_is", "_use", "_made").where("not _is and _made is not null")
    if across_sessions:  # a use is taken by its first result
        nth = F.row_number().over(Window.partitionBy("tool_use_id", "_made.session_id", "_made.line_no", "_made.block_idx").orderBy(*order))
        rows = rows.withColumn("_nth", nth).where("_nth = 1")
    calls = rows.select("tool_use_id", F.col("_made.session_id").alias("session_id"), F.col("_made.message_id").alias("message_id"), "_made.tool_name", "_made.input_json", F.substring("_out.full_output", 1, star.truncate).alias("result_text"), F.col("_out.is_error").alias("is_error"), F.col("_made.ts").alias("timestamp"), F.col("_out.ts").alias("result_timestamp"))
    if unresolved:
        open_uses = star.uses.select(F.col("id").alias("tool_use_id"), "session_id", "message_id", "tool_name", "input_json", F.col("ts").alias("timestamp")).join(calls.select("session_id", "tool_use_id").distinct(), ["session_id", "tool_use_id"], "left_anti")
        calls = calls.unionByName(open_uses, allowMissingColumns=True)
    return calls


def thinking_of(star: Star, across_sessions: bool = False) -> DataFrame:
    thought = star.placed.where("type = 'thinking'")
    if across_sessions:  # numbered through all conversations
        thought = global_row_numbers(thought, ["session_no", "line_no", "block_idx"], "_n").withColumn("id", F.col("_n") + 1)
    else:
        thought = thought.withColumn("id", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no", "block_idx")))
    return thought.select(F.col("id").cast("int").alias("id"), "session_id", "message_id", F.substring(F.coalesce("thinking", F.lit("")), 1, star.truncate).alias("content"), F.col("ts").alias("timestamp"))


def simple_tables(entries: DataFrame, truncate: int = fixed.TRUNCATE, include_thinking: bool = False, unresolved: bool = False, across_sessions: bool = False) -> dict[str, DataFrame]:
    """The four tables. unresolved keeps tool calls without a result; across_sessions links results of any session, once for each use."""
    star = Star(entries, truncate, keep=True)
    thinking = thinking_of(star, across_sessions)
    return {"sessions": sessions_of(star), "messages": messages_of(star), "tool_calls": calls_of(star, unresolved, across_sessions), "thinking": thinking if include_thinking else thinking.limit(0)}


def from_account_export(spark, folder: str, conversation_ids: list[str] | None = None, include_thinking: bool = True) -> dict[str, DataFrame]:
    """An account's export in the simple schema; results are linked across conversations, in the file's order, each use once."""
    entries = transcripts.account_export(spark, folder, conversation_ids, include_thinking)["entries"]
    return simple_tables(entries, include_thinking=include_thinking, across_sessions=True)

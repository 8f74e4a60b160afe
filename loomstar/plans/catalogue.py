"""The analytic queries over the star schema. {names} stand for tables; texts are SQL that Spark and others share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomstar.operators import numbering

CATALOGUE = {
    "tool_usage_by_category": """
        SELECT t.tool_category, COUNT(*) AS usage_count, ROUND(AVG(c.output_char_count), 4) AS avg_output_size
        FROM {fact_tool_calls} c JOIN {dim_tool} t ON c.tool_key = t.tool_key GROUP BY t.tool_category""",
    "messages_by_model_family": """
        SELECT d.year, d.month, m.model_family, COUNT(*) AS message_count
        FROM {fact_messages} f JOIN {dim_date} d ON f.date_key = d.date_key JOIN {dim_model} m ON f.model_key = m.model_key
        GROUP BY d.year, d.month, m.model_family""",
    "activity_by_time_of_day": """
        SELECT t.time_of_day, COUNT(*) AS message_count, CAST(SUM(CASE WHEN f.has_tool_use THEN 1 ELSE 0 END) AS BIGINT) AS tool_uses,
               CASE t.time_of_day WHEN 'morning' THEN 1 WHEN 'afternoon' THEN 2 WHEN 'evening' THEN 3 ELSE 4 END AS place
        FROM {fact_messages} f JOIN {dim_time} t ON f.time_key = t.time_key GROUP BY t.time_of_day""",
    "session_productivity": """
        SELECT p.project_name, s.session_id, s.git_branch, f.total_messages, f.total_tool_calls,
               ROUND(CAST(f.total_tool_calls AS DOUBLE) / NULLIF(f.total_messages, 0), 2) AS tools_per_message,
               ROUND(CAST(f.session_duration_seconds AS DOUBLE) / 60, 4) AS duration_minutes
        FROM {fact_session_summary} f JOIN {dim_session} s ON f.session_key = s.session_key JOIN {dim_project} p ON f.project_key = p.project_key
        ORDER BY f.first_timestamp DESC, s.session_id LIMIT 20""",
    "content_block_analysis": """
        SELECT k.block_type, COUNT(*) AS block_count, ROUND(AVG(b.content_length), 4) AS avg_length, MAX(b.content_length) AS max_length
        FROM {fact_content_blocks} b JOIN {dim_content_block_type} k ON b.content_block_type_key = k.content_block_type_key GROUP BY k.block_type""",
    "weekend_activity": """
        SELECT CASE WHEN d.is_weekend THEN 'Weekend' ELSE 'Weekday' END AS period, COUNT(*) AS message_count, COUNT(DISTINCT f.session_key) AS session_count
        FROM {fact_session_summary} f JOIN {dim_date} d ON f.date_key = d.date_key GROUP BY d.is_weekend""",
    "file_operations_by_extension": """
        SELECT x.file_extension, o.operation_type, COUNT(*) AS operation_count, ROUND(AVG(o.file_size_chars), 4) AS avg_file_size
        FROM {fact_file_operations} o JOIN {dim_file} x ON o.file_key = x.file_key GROUP BY x.file_extension, o.operation_type
        ORDER BY operation_count DESC, x.file_extension, o.operation_type LIMIT 20""",
    "code_blocks_by_language": """
        SELECT l.language_name, COUNT(*) AS block_count, CAST(SUM(b.line_count) AS BIGINT) AS total_lines, ROUND(AVG(b.line_count), 4) AS avg_lines_per_block
        FROM {fact_code_blocks} b JOIN {dim_programming_language} l ON b.language_key = l.language_key GROUP BY l.language_name""",
    "errors_by_tool": """
        SELECT t.tool_name, k.error_type, COUNT(*) AS error_count
        FROM {fact_errors} e JOIN {dim_tool} t ON e.tool_key = t.tool_key JOIN {dim_error_type} k ON e.error_type_key = k.error_type_key
        GROUP BY t.tool_name, k.error_type ORDER BY error_count DESC, t.tool_name LIMIT 15""",
    "tokens_by_model": """
        SELECT m.model_family, COUNT(*) AS message_count, CAST(SUM(f.word_count) AS BIGINT) AS total_words, CAST(SUM(f.estimated_tokens) AS BIGINT) AS total_tokens,
               ROUND(AVG(f.estimated_tokens), 4) AS avg_tokens_per_message
        FROM {fact_messages} f JOIN {dim_model} m ON f.model_key = m.model_key GROUP BY m.model_family""",
    "response_time_by_type": """
        SELECT k.message_type, ROUND(AVG(CAST(f.response_time_seconds AS DOUBLE)), 3) AS avg_response_time, ROUND(CAST(MAX(f.response_time_seconds) AS DOUBLE), 3) AS max_response_time, COUNT(*) AS message_count
        FROM {fact_messages} f JOIN {dim_message_type} k ON f.message_type_key = k.message_type_key WHERE f.response_time_seconds IS NOT NULL GROUP BY k.message_type""",
    "conversation_depth_by_session": """
        SELECT s.session_id, MAX(f.conversation_depth) AS max_depth, ROUND(AVG(f.conversation_depth), 4) AS avg_depth, COUNT(*) AS message_count
        FROM {fact_messages} f JOIN {dim_session} s ON f.session_key = s.session_key GROUP BY s.session_id""",
    "entities_by_type": """
        SELECT k.entity_type, COUNT(*) AS mention_count, COUNT(DISTINCT e.entity_normalized) AS unique_entities
        FROM {fact_entity_mentions} e JOIN {dim_entity_type} k ON e.entity_type_key = k.entity_type_key GROUP BY k.entity_type""",
    "tool_transitions": """
        SELECT c.tool_name AS current_tool, p.tool_name AS previous_tool, COUNT(*) AS transition_count, ROUND(AVG(CAST(s.time_since_prev_seconds AS DOUBLE)), 2) AS avg_time_between
        FROM {fact_tool_chain_steps} s JOIN {dim_tool} c ON s.tool_key = c.tool_key LEFT JOIN {dim_tool} p ON s.prev_tool_key = p.tool_key
        GROUP BY c.tool_name, p.tool_name ORDER BY transition_count DESC, current_tool, previous_tool LIMIT 20""",
    "messages_by_intent": """
        SELECT i.intent_name, i.intent_category, COUNT(*) AS message_count, ROUND(AVG(CAST(e.complexity_score AS DOUBLE)), 4) AS avg_complexity
        FROM {fact_message_enrichment} e JOIN {dim_intent} i ON e.intent_key = i.intent_key GROUP BY i.intent_name, i.intent_category""",
    "similar_file_context": """
        SELECT DISTINCT s.session_id, s.cwd, p.project_name, f.message_id, f.timestamp
        FROM {fact_file_operations} o JOIN {dim_file} x ON o.file_key = x.file_key JOIN {dim_session} s ON o.session_key = s.session_key
        JOIN {dim_project} p ON s.project_key = p.project_key JOIN {fact_messages} f ON o.session_key = f.session_key
        WHERE x.file_path LIKE '%m7%' AND f.content_text IS NOT NULL ORDER BY f.timestamp DESC, f.message_id LIMIT 20""",
    "fast_session_patterns": """
        SELECT c.tool_name, p.tool_name AS prev_tool, COUNT(*) AS transitions, ROUND(AVG(CAST(m.session_duration_seconds AS DOUBLE)), 2) AS avg_session_duration
        FROM {fact_tool_chain_steps} s JOIN {dim_tool} c ON s.tool_key = c.tool_key LEFT JOIN {dim_tool} p ON s.prev_tool_key = p.tool_key
        JOIN {session_quartiles} m ON s.session_key = m.session_key WHERE m.quartile = 1 GROUP BY c.tool_name, p.tool_name HAVING COUNT(*) > 5""",
    "session_state": """
        SELECT s.session_id, s.cwd, s.git_branch, f.message_id, f.content_text, f.conversation_depth, k.message_type, m.model_name
        FROM {fact_messages} f JOIN {dim_session} s ON f.session_key = s.session_key JOIN {dim_message_type} k ON f.message_type_key = k.message_type_key
        LEFT JOIN {dim_model} m ON f.model_key = m.model_key WHERE s.session_id = 'c3'""",
    "session_files": """
        SELECT s.session_id, x.file_path, o.operation_type, COUNT(*) AS operations
        FROM {fact_file_operations} o JOIN {dim_file} x ON o.file_key = x.file_key JOIN {dim_session} s ON o.session_key = s.session_key
        GROUP BY s.session_id, x.file_path, o.operation_type""",
    "training_extraction": """
        SELECT f.message_id, f.content_text, k.message_type, i.intent_name
        FROM {fact_messages} f JOIN {dim_message_type} k ON f.message_type_key = k.message_type_key JOIN {fact_message_enrichment} e ON f.message_id = e.message_id
        JOIN {dim_intent} i ON e.intent_key = i.intent_key JOIN {fact_session_insights} g ON f.session_key = g.session_key
        WHERE i.intent_name = 'debug' AND g.task_completed AND e.confidence_score > 0.8""",
    "error_share_by_tool": """
        SELECT x.file_extension, t.tool_name, k.error_type, COUNT(*) AS error_count, ROUND(COUNT(*) * CAST(100 AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY t.tool_name), 4) AS error_pct
        FROM {fact_errors} e JOIN {fact_file_operations} o ON e.tool_call_id = o.tool_call_id JOIN {dim_file} x ON o.file_key = x.file_key
        JOIN {dim_tool} t ON e.tool_key = t.tool_key JOIN {dim_error_type} k ON e.error_type_key = k.error_type_key
        GROUP BY x.file_extension, t.tool_name, k.error_type HAVING COUNT(*) > 3""",
    "cost_estimate": """
        SELECT p.project_name, m.model_family, CAST(SUM(f.estimated_tokens) AS BIGINT) AS total_tokens,
               ROUND(CASE m.model_family WHEN 'opus' THEN SUM(f.estimated_tokens) * CAST(0.000015 AS DOUBLE) WHEN 'sonnet' THEN SUM(f.estimated_tokens) * CAST(0.000003 AS DOUBLE)
                     WHEN 'haiku' THEN SUM(f.estimated_tokens) * CAST(0.00000025 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 9) AS estimated_cost_usd
        FROM {fact_messages} f JOIN {dim_model} m ON f.model_key = m.model_key JOIN {dim_session} s ON f.session_key = s.session_key JOIN {dim_project} p ON s.project_key = p.project_key
        GROUP BY p.project_name, m.model_family""",
    "knowledge_entities": """
        SELECT k.entity_type, e.entity_normalized, e.context_snippet, p.project_name, s.session_id, f.timestamp
        FROM {fact_entity_mentions} e JOIN {dim_entity_type} k ON e.entity_type_key = k.entity_type_key JOIN {fact_messages} f ON e.message_id = f.message_id
        JOIN {dim_session} s ON e.session_key = s.session_key JOIN {dim_project} p ON s.project_key = p.project_key WHERE k.entity_type IN ('function_name', 'class_name', 'file_path', 'git_ref')""",
    "workflow_replay": """
        SELECT c.chain_id, c.step_position, t.tool_name, t.tool_category, l.input_summary, ROUND(CAST(c.time_since_prev_seconds AS DOUBLE), 2) AS time_since_prev
        FROM {fact_tool_chain_steps} c JOIN {dim_tool} t ON c.tool_key = t.tool_key JOIN {fact_tool_calls} l ON c.tool_call_id = l.tool_call_id
        JOIN {fact_session_insights} g ON c.session_key = g.session_key WHERE g.task_completed AND g.outcome_status = 'success'""",
}


#: Where two facts meet, one that isn't to be broadcast: by the size of its files it may look small, but it has a row for each message or call.
MERGED = {"workflow_replay": "fact_tool_calls", "similar_file_context": "fact_messages", "training_extraction": "fact_message_enrichment", "error_share_by_tool": "fact_file_operations", "knowledge_entities": "fact_messages"}


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def run(spark: SparkSession, name: str, table) -> DataFrame:
    """A query of the catalogue. table gives the DataFrame of a name."""
    sql = CATALOGUE[name]
    given = {n: session_quartiles(table) if n == "session_quartiles" else table(n) for n in names_in(sql)}
    return spark.sql(sql, **{n: df.hint("merge") if n == MERGED.get(name) else df for n, df in given.items()})


def session_quartiles(table) -> DataFrame:
    """Sessions with tool calls in four tiles, the shortest first."""
    return numbering.ntile(table("fact_session_summary").where("total_tool_calls > 0"), 4, ["session_duration_seconds", "session_key"], "quartile")

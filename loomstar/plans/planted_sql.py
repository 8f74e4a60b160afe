"""What the planted transcripts hold, in plain SQL over the conversations."""

from __future__ import annotations

from loomstar.functions import fixed
from loomstar.plans.planted import FENCES, NAMES, ODD_INPUT_TEXT, ODD_TEXT, START, STRINGS, TOOLS, TRUNCATE, VALUES


def text_of(text: str) -> str:
    """A SQL text with conversation and turn in place of {c} and {t}."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{c}", "' || c || '").replace("{t}", "' || t || '") + "'"


#: Entity type, what its pattern matches in the sentence of names, and the part of it that is the name.
MENTIONS = [("file_path", " /src/app_{c}.py", "/src/app_{c}.py"), ("url", "https://example.org/{c}", "https://example.org/{c}"), ("class_name", "class Foo{c}", "Foo{c}"), ("function_name", "def go_{t}(", "go_{t}"), ("package_name", "import os", "os"), ("git_ref", "main", "main"), ("error_code", "OSError", "OSError")]
mentions = " UNION ALL ".join(f"SELECT message_id, session_id, full_text, '{kind}' AS entity_type, {text_of(own)} AS entity_text, text_length + instr({text_of(NAMES)}, {text_of(whole)}) - 1 AS position_start, length({text_of(whole)}) AS n FROM pe WHERE named" for kind, whole, own in MENTIONS)
code = [("py", "python", "print(1)\nx = 2\n"), ("", "unknown", "plain\n")]
codes = " UNION ALL ".join(f"SELECT message_id || '-code-{i}' AS code_block_id, message_id, md5(session_id) AS session_key, md5('{name}') AS language_key, date_key, time_key, {i} AS block_index, {body.count(chr(10)) + 1} AS line_count, {len(body)} AS char_count, {text_of(body)} AS code_text FROM pe WHERE fenced" for i, (_, name, body) in enumerate(code))
languages = " UNION ALL ".join(f"SELECT '{name}' AS language_name, '{','.join(fixed.LANGUAGE_EXTENSIONS.get(name, []))}' AS file_extensions" for _, name, _ in code)

COMMIT = "'[main ' || substr(md5(conv_id || '-' || turn), 1, 8) || '] Commit ' || turn"
plain = " ".join(f"WHEN {k} THEN {text_of(value).replace('|| c ||', '|| conv_id ||').replace('|| t ||', '|| turn ||')}" for k, value in enumerate([*STRINGS, *VALUES.values()], 2))

TABLES = {
    "pall": f"""SELECT conv_id AS c, turn AS t, role, text, 'p' || conv_id AS session_id, '/w/q' || (conv_id % 3) AS project_path, conv_id || '-' || turn AS message_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_uuid,
        TIMESTAMP '1970-01-01 00:00:00' + to_seconds({START} + conv_id * 3607 + turn * 61) AS ts, CASE WHEN turn > 0 THEN '/work' END AS cwd, 'b' || (turn % 2) AS git_branch, '1.' || turn AS version, conv_id % 6 = 0 AS is_sidechain, turn = 0 AND conv_id % 5 = 0 AS is_meta,
        role = 'user' AND turn > 0 AND (conv_id + turn) % 4 = 0 AS is_compact_summary, 's' || (conv_id % 13) AS slug, CASE conv_id % 9 WHEN 1 THEN {COMMIT} {plain} ELSE 'ok' || chr(10) || {COMMIT} || chr(10) || 'rest' END AS plain_result, conv_id % 9 <= {1 + len(STRINGS)} AS is_string, conv_id % 9 <= 1 AS commits,
        CASE WHEN conv_id % 4 = 1 THEN '{ODD_TEXT}' ELSE {COMMIT} || ' done' END AS mixed_result, CASE WHEN role = 'user' AND turn % 3 > 0 OR role = 'assistant' THEN 'array' ELSE 'string' END AS content_kind FROM conversations""",
    "pe": f"""SELECT *, CASE WHEN role = 'assistant' THEN text || CASE WHEN fenced THEN {text_of(FENCES)} ELSE '' END || CASE WHEN named THEN {text_of(NAMES)} ELSE '' END WHEN t % 3 = 1 THEN '' ELSE text END AS full_text, length(text) + CASE WHEN fenced THEN {len(FENCES)} ELSE 0 END AS text_length,
        CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(strftime(ts, '%H%M') AS INTEGER) AS time_key, CAST(row_number() OVER (PARTITION BY c ORDER BY t) - 1 AS INTEGER) AS depth, lag(ts) OVER (PARTITION BY c ORDER BY t) AS parent_ts
        FROM (SELECT *, role = 'assistant' AND (c + t) % 3 = 0 AS fenced, role = 'assistant' AND (c + t) % 5 = 1 AS named, role = 'assistant' AND (c + t) % 2 = 0 AS thinks FROM pall WHERE role IN ('user', 'assistant'))""",
    "pb": f"""SELECT c, t, role, session_id, message_id, ts, date_key, time_key, 0 AS block_idx, 'thinking' AS type, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS tool_use_id, FALSE AS is_error, 'On turn ' || t AS thinking, CAST(NULL AS VARCHAR) AS value, FALSE AS list FROM pe WHERE thinks
        UNION ALL SELECT c, t, role, session_id, message_id, ts, date_key, time_key, CAST(thinks AS INTEGER), 'text', full_text, NULL, NULL, NULL, FALSE, NULL, NULL, FALSE FROM pe WHERE role = 'assistant'
        UNION ALL SELECT c, t, role, session_id, message_id, ts, date_key, time_key, 1 + CAST(thinks AS INTEGER), 'tool_use', NULL, 't' || c || '-' || t, CASE (c + t) % 4 WHEN 0 THEN '{TOOLS[0]}' WHEN 1 THEN '{TOOLS[1]}' WHEN 2 THEN '{TOOLS[2]}' ELSE '{TOOLS[3]}' END, NULL, FALSE, NULL, '{{"file_path": "/src/m' || (c % 11) || '.py", "n": ' || t || '}}', FALSE FROM pe WHERE role = 'assistant'
        UNION ALL SELECT c, t, role, session_id, message_id, ts, date_key, time_key, 0, 'tool_result', NULL, NULL, NULL, 't' || c || '-' || (t - 1), c % 7 = 0, NULL, plain_result, NOT is_string FROM pe WHERE role = 'user' AND t % 3 = 1
        UNION ALL SELECT c, t, role, session_id, message_id, ts, date_key, time_key, 0, 'text', text, NULL, NULL, NULL, FALSE, NULL, NULL, FALSE FROM pe WHERE role = 'user' AND t % 3 = 2
        UNION ALL SELECT c, t, role, session_id, message_id, ts, date_key, time_key, 2, 'tool_result', NULL, NULL, NULL, 't' || c || '-' || (t - 1), FALSE, NULL, mixed_result, TRUE FROM pe WHERE role = 'user' AND t % 3 = 2""",
    "pseg": """SELECT *, CAST((conversation - 1) // 5 + 1 AS INTEGER) AS page FROM (SELECT *, role = 'user' AND trim(full_text) <> '' AS is_prompt, CAST(sum(CASE WHEN role = 'user' AND trim(full_text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t) AS INTEGER) AS conversation FROM pe) WHERE conversation > 0""",
    "psum": """SELECT session_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 197) || '...' ELSE s END AS summary FROM (SELECT session_id, coalesce(max(CASE WHEN t = 0 AND c % 4 = 3 THEN 'About ' || c END), arg_min(trim(text), t) FILTER (role = 'user' AND t % 3 <> 1 AND NOT is_meta AND trim(text) <> '' AND NOT starts_with(trim(text), '<')), '(no summary)') AS s FROM pall GROUP BY session_id)""",
    "pfile": f"SELECT 'p' || conv_id AS session_id, 'q' || (conv_id % 3) AS project, '/w/p' || conv_id || '.jsonl' AS path, TIMESTAMP '1970-01-01 00:00:00' + to_seconds({START} + conv_id) AS modified, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY conv_id",
    "pcall": f"""SELECT r.tool_use_id AS tool_call_id, md5(r.session_id) AS session_key, md5(u.name) AS tool_key, u.date_key, u.time_key, u.message_id AS invoke_message_id, r.message_id AS result_message_id, u.ts AS timestamp, CAST(length(u.value) AS INTEGER) AS input_char_count, CAST(length(r.value) AS INTEGER) AS output_char_count, r.is_error, u.value AS input_json, substr(u.value, 1, {TRUNCATE}) AS input_summary, substr(r.value, 1, {TRUNCATE}) AS output_text
        FROM pb r JOIN pb u ON r.tool_use_id = u.id WHERE r.type = 'tool_result'""",
    "pmention": f"""SELECT md5(message_id || '|' || entity_type || '|' || position_start) AS mention_id, message_id, md5(session_id) AS session_key, md5(entity_type) AS entity_type_key, entity_text, lower(entity_text) AS entity_normalized, substr(full_text[greatest(1, position_start - 49):position_start + n + 50], 1, 200) AS context_snippet, CAST(position_start AS INTEGER) AS position_start, CAST(position_start + n AS INTEGER) AS position_end FROM ({mentions})""",
    "xuse": f"SELECT c, t, session_id, message_id, ts, 2 AS b, TRUE AS is_use, CASE WHEN t = 1 THEN 'shared' WHEN c % 2 = 0 THEN 'tool_p' || c || '_' || c || '-' || t ELSE 'k' || c || '-' || t END AS id, {text_of(ODD_INPUT_TEXT)} AS value FROM pe WHERE role = 'assistant' UNION ALL SELECT c, t, session_id, message_id, ts, 1, FALSE, CASE WHEN t IN (0, 2) THEN 'shared' WHEN c % 2 = 0 THEN 'tool_p' || c || '_' || c || '-' || (t - 1) ELSE 'k' || c || '-' || (t - 1) END, CASE WHEN t % 4 = 0 THEN '[''odd'', {{''a'': 1}}]' ELSE 'out }} ' || c END FROM pe WHERE role = 'user'",
    "xlink": "SELECT *, max(CASE WHEN is_use THEN c * 1000 + t END) OVER (PARTITION BY id ORDER BY c, t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM xuse",
    "xcall": "SELECT * FROM xlink WHERE NOT is_use AND used IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, used ORDER BY c, t) = 1",
    "pcode": codes,
    "planguage": f"SELECT DISTINCT md5(language_name) AS language_key, language_name, file_extensions FROM ({languages}) WHERE EXISTS (FROM pcode)",
    "pmessage": f"""SELECT message_id, md5(session_id) AS session_key, md5(project_path) AS project_key, md5(role) AS message_type_key, CASE WHEN role = 'assistant' THEN md5('m-opus-9') END AS model_key, date_key, time_key, parent_uuid AS parent_message_id, ts AS timestamp, CAST(length(full_text) AS INTEGER) AS content_length,
        CASE WHEN role = 'assistant' THEN 2 + CAST(thinks AS INTEGER) WHEN t % 3 = 2 THEN 2 ELSE 1 END AS content_block_count, role = 'assistant' AS has_tool_use, role = 'user' AND t % 3 > 0 AS has_tool_result, thinks AS has_thinking, full_text AS text, CAST((epoch_us(ts) - epoch_us(parent_ts)) / CAST(1000000 AS DOUBLE) AS FLOAT) AS response_time_seconds, depth AS conversation_depth, substr(full_text, 1, {TRUNCATE}) AS content_text, is_sidechain FROM pe""",
    "pblock": f"""SELECT message_id || '-' || block_idx AS content_block_id, message_id, md5(session_id) AS session_key, md5(type) AS content_block_type_key, date_key, time_key, block_idx AS block_index, CAST(length(CASE WHEN type = 'text' THEN text ELSE substr(value, 1, {TRUNCATE}) END) AS INTEGER) AS content_length, substr(coalesce(text, value), 1, {TRUNCATE}) AS content_text FROM pb WHERE type <> 'thinking'
        UNION ALL SELECT message_id || '-0', message_id, md5(session_id), md5('text'), date_key, time_key, 0, CAST(length(text) AS INTEGER), substr(text, 1, {TRUNCATE}) FROM pe WHERE content_kind = 'string'""",
}

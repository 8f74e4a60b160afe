"""Queries over the planted transcripts: readers, blocks, discovery, stars, conversations and search, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.functions import fixed
from loomstar.operators import conversation, inspection, search_index, simple
from loomstar.operators.links import cut, shared_folder
from loomstar.operators.star import Star
from loomstar.plans import catalogue, oracle, planted
from loomstar.plans.given_tables import read
from loomstar.sources import ordered_text, sinks, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = oracle.over(sql)
        return f

    return add


def all_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = planted.star(spark, sf_dir).all_entries
    return entries, transcripts.blocks(transcripts.messages_only(entries))


def segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries, blocks = all_entries(spark, sf_dir)
    return conversation.segments(transcripts.message_texts(transcripts.messages_only(entries), blocks)), blocks


# Lines, blocks and discovery.


@query("""SELECT session_id, project_path, CAST(t * 3 AS INTEGER) AS line_no, role AS type, message_id AS uuid, parent_uuid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text, ts, content_kind, cwd, git_branch, version, is_sidechain, is_meta, is_compact_summary, slug, CAST(NULL AS VARCHAR) AS summary, TRUE AS has_message FROM pall
    UNION ALL SELECT session_id, project_path, CAST(t * 3 + 1 AS INTEGER), CASE WHEN t = 0 THEN 'summary' ELSE 'file-history-snapshot' END, '', NULL, '', NULL, 'other', NULL, NULL, NULL, FALSE, FALSE, FALSE, NULL, CASE WHEN t = 0 THEN 'About ' || c END, FALSE FROM pall WHERE (c + t) % 4 = 3""")
def jsonl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of JSON text; blank and broken lines and those that aren't objects are dropped, their numbers kept."""
    rows = transcripts.parse_lines(planted.lines(read(spark, sf_dir, "conversations")))
    return rows.select("session_id", "project_path", "line_no", "type", "uuid", "parent_uuid", "ts_text", "ts", "content_kind", "cwd", "git_branch", "version", "is_sidechain", "is_meta", "is_compact_summary", "slug", "summary", "has_message")


@query("SELECT session_id, CAST(t * 3 AS INTEGER) AS line_no, CAST(block_idx AS INTEGER) AS block_idx, type, text, id, name, tool_use_id, is_error, thinking FROM pb")
def jsonl_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_entries(spark, sf_dir)[1].select("session_id", "line_no", "block_idx", "type", "text", "id", "name", "tool_use_id", "is_error", "thinking")


@query("""SELECT session_id, project_path, CAST(line AS INTEGER) AS cwd_line, coalesce(f, l).cwd AS cwd, coalesce(f, l).git_branch AS git_branch, coalesce(f, l).version AS version, coalesce(f, l).is_sidechain AS is_sidechain, session_id AS log_session_id
    FROM (SELECT session_id, project_path, min(t * 3) FILTER (t > 0) AS line, arg_min({'cwd': cwd, 'git_branch': git_branch, 'version': version, 'is_sidechain': is_sidechain}, t) FILTER (t > 0) AS f, arg_max({'cwd': cwd, 'git_branch': git_branch, 'version': version, 'is_sidechain': is_sidechain}, t) AS l FROM pe GROUP BY session_id, project_path)""")
def jsonl_session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.session_metadata(all_entries(spark, sf_dir)[0]).select("session_id", "project_path", "cwd_line", "cwd", "git_branch", "version", "is_sidechain", "log_session_id")


@query("SELECT * FROM psum")
def jsonl_session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.session_summaries(*all_entries(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return transcripts.find_sessions(planted.files(read(spark, sf_dir, "conversations")), transcripts.session_summaries(*all_entries(spark, sf_dir)), **options)


@query("SELECT session_id, project, path, modified, size, summary FROM pfile JOIN psum USING (session_id) WHERE lower(summary) <> 'warmup' AND summary <> '(no summary)' AND contains(project, 'q1')")
def jsonl_find_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, project="Q1")


@query("SELECT project, count(*) AS n, max(modified) AS newest, arg_max(session_id, modified) AS newest_session, CAST(sum(size) AS BIGINT) AS size FROM pfile JOIN psum USING (session_id) WHERE lower(summary) <> 'warmup' AND summary <> '(no summary)' GROUP BY project")
def jsonl_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.projects(found(spark, sf_dir))
    return rows.select("project", "n", "newest", F.col("sessions")[0]["session_id"].alias("newest_session"), F.aggregate("sessions", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("size"))


@query("SELECT slug, count(*) AS n_sessions, CAST(sum(size) AS BIGINT) AS total_size, min(modified) AS first_modified, max(modified) AS last_modified, arg_max(summary, modified) AS summary FROM pfile JOIN (SELECT session_id, arg_min(slug, t) AS slug FROM pall GROUP BY session_id) USING (session_id) LEFT JOIN psum USING (session_id) GROUP BY slug")
def jsonl_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, blocks = all_entries(spark, sf_dir)
    return transcripts.chains(planted.files(read(spark, sf_dir, "conversations")), entries, transcripts.session_summaries(entries, blocks))


@query("""SELECT '$.text' AS path, 'string' AS kind, count(*) AS n, count(*) AS documents, CAST(min(length(text)) AS INTEGER) AS length_min, CAST(max(length(text)) AS INTEGER) AS length_max, CAST(1 AS DOUBLE) AS presence, CAST(NULL AS VARCHAR) AS formats, CAST(NULL AS VARCHAR) AS enum_values FROM conversations
    UNION ALL SELECT '$.role', 'string', count(*), count(*), CAST(min(length(role)) AS INTEGER), CAST(max(length(role)) AS INTEGER), CAST(1 AS DOUBLE), 'enum_like=' || count(*), (SELECT string_agg(role, ',' ORDER BY role) FROM (SELECT DISTINCT role FROM conversations)) FROM conversations
    UNION ALL SELECT '$.tags', 'array', count(*), count(*), NULL, NULL, count(*) / CAST((SELECT count(*) FROM conversations) AS DOUBLE), NULL, NULL FROM conversations WHERE turn % 2 = 0
    UNION ALL SELECT '$.tags[]', 'integer', count(*), count(*), NULL, NULL, count(*) / CAST((SELECT count(*) FROM conversations) AS DOUBLE), NULL, NULL FROM conversations WHERE turn % 2 = 0
    UNION ALL SELECT '$.tags[]', 'boolean', count(*), count(*), NULL, NULL, count(*) / CAST((SELECT count(*) FROM conversations) AS DOUBLE), NULL, NULL FROM conversations WHERE turn % 2 = 0
    UNION ALL SELECT '$', 'object', count(*), count(*), NULL, NULL, CAST(1 AS DOUBLE), NULL, NULL FROM conversations""")
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged structure of JSON documents of conversations: lengths, formats and few-valued fields of strings, presence."""
    rows = read(spark, sf_dir, "conversations")
    own = rows.select(F.to_json(F.struct("text", "role", F.when(F.col("turn") % 2 == 0, F.from_json(F.lit('["1", "true"]'), "array<string>")).alias("tags"))).alias("doc"))
    own = own.select(F.regexp_replace("doc", r'\["1","true"\]', "[1,true]").alias("doc"))
    formats = F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return inspection.profile(own, "doc").select("path", "kind", "n", "documents", "length_min", "length_max", "presence", formats.alias("formats"), F.array_join("enum_values", ",").alias("enum_values"))


# The star, with truncated texts and without thinking.


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 4).alias(c) if k == "float" else F.col(c) for c, k in df.dtypes])


@query(f"SELECT * EXCLUDE (text, response_time_seconds), round(CAST(response_time_seconds AS DOUBLE), 4) AS response_time_seconds, {oracle.WORDS} AS word_count, {oracle.TOKENS} AS estimated_tokens FROM pmessage")
def jsonl_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(planted.star(spark, sf_dir).table("fact_messages").drop("content_json"))


@query("SELECT * FROM pblock")
def jsonl_content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.star(spark, sf_dir).table("fact_content_blocks").drop("content_json")


@query("SELECT * FROM pcall")
def jsonl_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are strings (some look like JSON), lists of texts and other values, or objects, numbers and null; those without an earlier use aren't calls."""
    return planted.star(spark, sf_dir).table("fact_tool_calls")


@query("""SELECT md5(session_id) AS session_key, md5(project_path) AS project_key, CAST(count(*) AS INTEGER) AS total_messages, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS user_messages, CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS assistant_messages, CAST((SELECT count(*) FROM pcall WHERE session_key = md5(session_id)) AS INTEGER) AS total_tool_calls, CAST(count(*) FILTER (thinks) AS INTEGER) AS total_thinking_blocks,
    CAST(sum(CASE WHEN role = 'assistant' OR t % 3 = 2 THEN 2 ELSE 1 END) AS INTEGER) AS total_content_blocks, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS INTEGER) AS session_duration_seconds FROM pe GROUP BY session_id, project_path""")
def jsonl_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.star(spark, sf_dir).table("fact_session_summary").drop("date_key", "first_timestamp", "last_timestamp")


@query("SELECT * FROM pcode")
def fact_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.star(spark, sf_dir).table("fact_code_blocks")


@query("SELECT * FROM planguage")
def dim_programming_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.star(spark, sf_dir).table("dim_programming_language")


@query("SELECT * FROM pmention")
def fact_entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, urls, functions, classes, packages, errors and git refs that texts name, with their places and surroundings."""
    return planted.star(spark, sf_dir).table("fact_entity_mentions")


CATALOGUE_NAMES = {"fact_code_blocks": "pcode", "dim_programming_language": "planguage", "fact_entity_mentions": "pmention", "fact_messages": "pmessage", "dim_session": "(SELECT DISTINCT md5(session_id) AS session_key, session_id, md5(project_path) AS project_key FROM pe)", "dim_project": "(SELECT DISTINCT md5(project_path) AS project_key, project_path, regexp_extract(project_path, '[^/]*$') AS project_name FROM pe)"}
for _name in ("code_blocks_by_language", "entities_by_type", "knowledge_entities"):
    _sql = catalogue.CATALOGUE[_name]
    for _table, _own in CATALOGUE_NAMES.items():
        _sql = _sql.replace("{" + _table + "}", _own)
    query(_sql, f"q_{_name}")(lambda spark, d, n=_name: catalogue.run(spark, n, planted.star(spark, d).table))


@query(f"SELECT CAST(row_number() OVER (PARTITION BY c ORDER BY t) AS INTEGER) AS id, session_id, message_id, thinking AS content, ts AS timestamp FROM pb WHERE type = 'thinking' AND {fixed.TRUNCATE} > 0")
def simple_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking blocks of the simple schema, numbered in each session."""
    return simple.simple_tables(planted.star(spark, sf_dir).all_entries, include_thinking=True)["thinking"]


#: Lines after a session's first turn that can't be loaded (or can, the last two), by the conversation's number modulo 10.
BROKEN = {
    1: ('{"type":"user","uuid":"x","message":null}', "the message is null"),
    2: ('{"type":"assistant","uuid":"x","message":"only text"}', "the message is string"),
    3: ('{"type":"user","uuid":"x","timestamp":1709251200,"message":{"content":"hi"}}', "the timestamp is scalar"),
    4: ('{"type":"assistant","uuid":"x","message":{"content":[{"type":"text","text":"ok"},{"type":"text","text":12}]}}', "the text of a block is scalar"),
    5: ('{"type":"assistant","uuid":"x","message":{"content":[{"type":"thinking","thinking":7}]}}', "the thinking of a block is scalar"),
    6: ('{"type":"user","uuid":"x","timestamp":0}', None),
    7: ('{"type":"assistant","uuid":"x","message":{"content":[{"type":"thinking","thinking":null}]}}', None),
}
_broken = " ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in BROKEN.items() if why)


@query(f"SELECT session_id, error, CASE WHEN error IS NULL THEN n + CAST(c % 10 IN (6, 7) AS INTEGER) ELSE 0 END AS n_messages, CASE WHEN error IS NULL THEN 'p' || c END AS written FROM (SELECT c, session_id, CASE c % 10 {_broken} END AS error, count(*) AS n FROM pe GROUP BY c, session_id)")
def sessions_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions broken in five ways are told with their reason; the others are written."""
    lines = planted.star(spark, sf_dir).lines
    first = lines.where("line_no = 0").withColumn("c", F.substring("session_id", 2, 20).cast("long"))
    more = F.lit(None).cast("string")
    for k, (line, _) in BROKEN.items():
        more = F.when(F.col("c") % 10 == k, line).otherwise(more)
    extra = first.select("session_id", "project_path", F.lit(2).alias("line_no"), more.alias("line")).where("line is not null")
    entries = cut(transcripts.parse_lines(lines.unionByName(extra)), "entries_with_broken")
    folder = fresh_folder(spark, "archive")
    sinks.write_counted({"fact_messages": Star(entries, keep=True).table("fact_messages"), "dim_session": Star(entries).table("dim_session")}, folder)
    failed = spark.read.parquet(sinks.write_failed(spark, entries, folder)["failed_path"])
    n = spark.read.parquet(f"{folder}/fact_messages").groupBy("session_key").agg(F.count(F.lit(1)).alias("n_messages"))
    written = spark.read.parquet(f"{folder}/dim_session").select(F.col("session_id").alias("written"), "session_key").join(n, "session_key").drop("session_key")
    every = transcripts.messages_only(entries).select("session_id").distinct()
    rows = every.join(failed.select("session_id", "error"), "session_id", "left").join(written, F.col("session_id") == F.col("written"), "left")
    return rows.select("session_id", "error", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "written")


# Sinks, written below the shared folder and read again.


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loomstar-{uuid.uuid4().hex}/{name}"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_told, count(*) AS n_read FROM {own}" for t, own in (("fact_tool_calls", "pcall"), ("fact_code_blocks", "pcode"), ("dim_programming_language", "planguage"), ("fact_messages", "pmessage"))))
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as JSON Lines: the rows that the manifest tells, and those read again."""
    s, folder = planted.star(spark, sf_dir), fresh_folder(spark, "json")
    tables = {t: s.table(t) for t in ("fact_tool_calls", "fact_code_blocks", "dim_programming_language", "fact_messages")}
    sinks.write_json(spark, tables, folder, "star")
    told = F.from_json(F.get_json_object("value", "$.row_counts"), "map<string, bigint>")
    told = spark.read.json(f"{folder}/meta").select(F.explode(told).alias("table_name", "n_told"))
    kinds = {t: "dimensions" if t.startswith("dim_") else "facts" for t in tables}
    read_again = [spark.read.schema(df.schema).json(f"{folder}/{kinds[t]}/{t}").agg(F.count(F.lit(1)).alias("n_read")).select(F.lit(t).alias("table_name"), "n_read") for t, df in tables.items()]
    return told.join(reduce(DataFrame.union, read_again), "table_name")


@query("SELECT tool_call_id, session_key, output_char_count, is_error FROM pcall")
def session_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table added to by session, twice, and a third time in part: later runs replace the rows of their sessions."""
    calls, folder = planted.star(spark, sf_dir).table("fact_tool_calls").select("tool_call_id", "session_key", "output_char_count", "is_error"), fresh_folder(spark, "sessions")
    for rows in (calls, calls, calls.where(F.col("session_key") < "8")):
        sinks.append_sessions(rows, folder)
    return spark.read.parquet(folder).select(calls.columns)


@query("SELECT id, type, role = 'user' AS of_user FROM (SELECT session_id || '#' || t || '#' || block_idx AS id, type, role FROM pb) WHERE id IS NOT NULL")
def search_index_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a name of their own as documents of an index, read again."""
    entries, blocks = all_entries(spark, sf_dir)
    rows = blocks.join(entries.select("session_id", "line_no", F.col("type").alias("role")), ["session_id", "line_no"])
    docs, folder = rows.select(F.concat_ws("#", "session_id", (F.col("line_no") / 3).cast("int"), "block_idx").alias("id"), "type", (F.col("role") == "user").alias("of_user")), fresh_folder(spark, "index")
    n = sinks.write_search_index(spark, docs, folder)
    found = spark.read.schema(docs.schema).json(f"{folder}/documents")
    return found.where(F.lit(n) > 0)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of an account's export, written as one JSON array in one file and read from it."""
    path = f"{fresh_folder(spark, 'export')}/conversations.json"
    sinks.write_json_array(spark, planted.exported(read(spark, sf_dir, "conversations")), ["conv_id"], "element", path)
    return cut(transcripts.account_conversations(spark, path), "account_conversations")


@query("SELECT row_number() OVER (ORDER BY c) - 1 AS session_no, substr(session_id, 1, 8) AS short_id, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(" + str(planted.START) + " + (c * 7919) % 1000 * 86400), '%Y-%m-%d') AS updated, CAST(n AS INTEGER) AS n_messages, 'Talk {' || c AS name FROM (SELECT c, session_id, count(*) AS n FROM pe GROUP BY ALL)")
def account_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export holds, with each conversation's place in the file."""
    return transcripts.listed_conversations(exported(spark, sf_dir))


@query("SELECT r.id AS tool_use_id, u.session_id, u.message_id, 'Edit' AS tool_name, u.value AS input_json, r.value AS result_text, u.ts AS timestamp, r.ts AS result_timestamp FROM xcall r JOIN xuse u ON u.is_use AND u.id = r.id AND u.c * 1000 + u.t = r.used")
def account_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of an export: inputs as they were, ids made where there are none, each call taken by the first result after it in the file."""
    tables = simple.simple_tables(transcripts.account_entries(exported(spark, sf_dir)), across_sessions=True)
    return tables["tool_calls"].select("tool_use_id", "session_id", "message_id", "tool_name", "input_json", "result_text", "timestamp", "result_timestamp")


@query("SELECT CAST(row_number() OVER (ORDER BY c, t) AS INTEGER) AS id, session_id, message_id, 'In ' || c || ' on ' || t AS content, ts AS timestamp FROM pe WHERE role = 'assistant' AND (c + t) % 2 = 0")
def account_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking blocks of an export, numbered through the whole file."""
    return simple.simple_tables(transcripts.account_entries(exported(spark, sf_dir)), include_thinking=True, across_sessions=True)["thinking"]


@query("""SELECT 'sessions' AS table_name, session_id AS id, CAST(count(*) AS VARCHAR) AS detail FROM pe GROUP BY session_id
    UNION ALL SELECT 'messages', message_id, md5(substr(full_text, 1, 2000)) FROM pe
    UNION ALL SELECT 'tool_calls', tool_use_id, substr(value, 1, 2000) FROM (SELECT r.tool_use_id, r.value FROM pb r JOIN pb u ON r.tool_use_id = u.id WHERE r.type = 'tool_result')
    UNION ALL SELECT 'thinking', message_id, thinking FROM pb WHERE type = 'thinking'""")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four simple tables as one JSON document in one file, read back."""
    path = f"{fresh_folder(spark, 'document')}/export.json"
    sinks.write_document(spark, simple.simple_tables(planted.star(spark, sf_dir).all_entries, include_thinking=True), path)
    row = "session_id string, message_id string, tool_use_id string, message_count int, content string, result_text string"
    rows = ordered_text.document_rows(spark, path).where(F.get_json_object("head", "$.schema_type") == "simple").select("table_name", F.from_json("element", row).alias("r"))
    id_ = F.when(F.col("table_name") == "sessions", F.col("r.session_id")).when(F.col("table_name") == "tool_calls", F.col("r.tool_use_id")).otherwise(F.col("r.message_id"))
    detail = F.when(F.col("table_name") == "sessions", F.col("r.message_count").cast("string")).when(F.col("table_name") == "messages", F.md5("r.content")).when(F.col("table_name") == "tool_calls", F.col("r.result_text")).otherwise(F.col("r.content"))
    return rows.select("table_name", id_.alias("id"), detail.alias("detail"))


@query("""WITH line AS (SELECT *, 2 * (row_number() OVER (PARTITION BY c % 4 ORDER BY c, t) - 1) AS n FROM pall)
    SELECT c % 4 AS file, CAST(n AS INTEGER) AS line_no, role AS type, message_id AS uuid FROM line
    UNION ALL SELECT c % 4, CAST(n + 1 AS INTEGER), CASE WHEN t = 0 THEN 'summary' ELSE 'file-history-snapshot' END, '' FROM line WHERE (c + t) % 4 = 3""")
def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of many sessions in four files at several paths, read by lines with exact numbers; half of the files are read by each of two readers."""
    lines, folder = planted.lines(read(spark, sf_dir, "conversations")), fresh_folder(spark, "lines")
    lines = cut(lines.withColumn("c", F.substring("session_id", 2, 20).cast("long")), "lines")
    for k in range(4):
        sinks.write_lines(spark, lines.where(F.col("c") % 4 == k), ["c", "line_no"], "line", f"{folder}/{k}/all {k}.jsonl")
    some = transcripts.read_session(spark, f"{folder}/0/all 0.jsonl").unionByName(transcripts.read_entries(spark, [f"{folder}/{k}/all {k}.jsonl" for k in (1, 2)]))
    entries = some.unionByName(transcripts.read_entries(spark, f"{folder}/3"))
    return entries.select(F.substring("session_id", 5, 1).cast("long").alias("file"), "line_no", "type", "uuid").where(F.col("project_path").endswith(F.concat(F.lit("/"), F.substring("session_id", 5, 1))))


# Conversations, timelines, search.


@query("SELECT session_id, CAST(t * 3 AS INTEGER) AS line_no, conversation, CAST(sum(CASE WHEN is_compact_summary THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY t) AS INTEGER) AS prompt FROM pseg WHERE is_prompt")
def jsonl_prompt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by number; one that sums up earlier context continues the prompt before."""
    return conversation.prompt_numbers(segmented(spark, sf_dir)[0]).select("session_id", "line_no", "conversation", "prompt")


@query("""SELECT session_id, conversation, coalesce(stats, '') AS tool_stats, coalesce(n_long, 0) AS n_long, commits FROM (SELECT DISTINCT session_id, conversation FROM pseg)
    LEFT JOIN (SELECT session_id, conversation, string_agg(n || ' ' || lower(name), ' . ' ORDER BY n DESC, name) AS stats FROM (SELECT session_id, conversation, name, count(*) AS n FROM pb JOIN (SELECT c, t, conversation FROM pseg) USING (c, t) WHERE type = 'tool_use' GROUP BY ALL) GROUP BY ALL) USING (session_id, conversation)
    LEFT JOIN (SELECT session_id, conversation, CAST(count(*) AS INTEGER) AS n_long FROM pb JOIN (SELECT c, t, conversation FROM pseg) USING (c, t) WHERE type = 'text' AND length(text) >= 300 GROUP BY ALL) USING (session_id, conversation)
    LEFT JOIN (SELECT session_id, conversation, string_agg(substr(md5(message_id), 1, 8) || ' Commit ' || t, ',' ORDER BY ts) AS commits FROM pb JOIN (SELECT c, t, conversation FROM pseg) USING (c, t) WHERE type = 'tool_result' AND NOT list AND c % 9 <= 1 GROUP BY ALL) USING (session_id, conversation)""")
def jsonl_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation did: tools by use, long texts, commits."""
    rows = conversation.analysis(*segmented(spark, sf_dir))
    commits = F.array_join(F.transform("commits", lambda x: F.concat(x["hash"], F.lit(" "), x["message"])), ",")
    return rows.select("session_id", "conversation", "tool_stats", F.when(F.col("long_texts").isNull(), 0).otherwise(F.size("long_texts")).alias("n_long"), commits.alias("commits"))


@query("""SELECT session_id, 'prompt' AS kind, trim(full_text) AS content, conversation, page FROM pseg WHERE is_prompt AND NOT is_compact_summary
    UNION ALL SELECT session_id, 'commit', substr(md5(message_id), 1, 8) || ' Commit ' || t, conversation, page FROM pseg WHERE role = 'user' AND t % 3 = 1 AND commits""")
def jsonl_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and commits, without prompts that only continue."""
    return conversation.timeline(*segmented(spark, sf_dir)).select("session_id", "kind", "content", "conversation", "page")


@query("""SELECT session_id, type, content, 'page-' || lpad(CAST(greatest(1, (users - 1) // 5 + 1) AS VARCHAR), 3, '0') || '.html' AS page_file, 'msg-' || replace(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ':', '-') AS anchor FROM (
    SELECT session_id, c, t, ts, 'user' AS type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM pe WHERE role = 'user' AND content_kind = 'string'
    UNION ALL SELECT session_id, c, t, ts, CASE WHEN type = 'text' THEN role ELSE type END, CASE WHEN type = 'text' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN type = 'tool_use' THEN name || ': ' || substr(value, 1, 1000) WHEN type = 'tool_result' AND NOT list THEN substr(value, 1, 500) END FROM pb)
    JOIN (SELECT c, t, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t) AS users FROM pe) USING (c, t) WHERE content <> ''""")
def jsonl_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of users and assistants, tool inputs and outputs, with page and anchor."""
    return conversation.search_documents(*all_entries(spark, sf_dir)).select("session_id", "type", "content", "page_file", "anchor")


@query("""WITH doc AS (SELECT session_id, type, content, 'page-' || lpad(CAST(greatest(1, (users - 1) // 5 + 1) AS VARCHAR), 3, '0') || '.html' AS page_file, 'msg-' || replace(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ':', '-') AS anchor FROM (
    SELECT session_id, c, t, ts, 'user' AS type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM pe WHERE role = 'user' AND content_kind = 'string'
    UNION ALL SELECT session_id, c, t, ts, CASE WHEN type = 'text' THEN role ELSE type END, CASE WHEN type = 'text' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN type = 'tool_use' THEN name || ': ' || substr(value, 1, 1000) WHEN type = 'tool_result' AND NOT list THEN substr(value, 1, 500) END FROM pb)
    JOIN (SELECT c, t, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t) AS users FROM pe) USING (c, t) WHERE content <> '') SELECT 'words' AS kind, session_id, type, content, page_file, anchor FROM doc WHERE contains(lower(content), 'src/m1') AND contains(lower(content), 'n')
    UNION ALL SELECT 'none', * FROM doc WHERE contains(lower(content), 'no such words') UNION ALL SELECT 'short', * FROM doc WHERE contains(lower(content), '7')
    UNION ALL SELECT 'session', * FROM doc WHERE session_id = 'p3' AND contains(lower(content), 'th')""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by posting lists of trigrams: words that many documents have, none has, too short ones, and within a session."""
    folder = fresh_folder(spark, "trigrams")
    search_index.write(conversation.search_documents(*all_entries(spark, sf_dir)), folder)
    asked = {"words": ("N SRC/m1", None), "none": ("no such words", None), "short": ("7", None), "session": ("th", "p3")}
    found = [search_index.search(spark, folder, q, 2**30, session=session).select(F.lit(kind).alias("kind"), "session_id", "type", "content", "page_file", "anchor") for kind, (q, session) in asked.items()]
    return reduce(DataFrame.union, found)


@query("SELECT * FROM pcall")
def json_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact as JSON Lines, every value read again."""
    calls, folder = planted.star(spark, sf_dir).table("fact_tool_calls"), fresh_folder(spark, "json_rows")
    sinks.write_json(spark, {"fact_tool_calls": calls}, folder, "star")
    return spark.read.schema(calls.schema).json(f"{folder}/facts/fact_tool_calls")

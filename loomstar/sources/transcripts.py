"""Session transcripts as DataFrames: one row for each entry, and one for each content block.

entries: session_id, project_path, line_no, type, uuid, parent_uuid, ts_text, ts, model, content (JSON text, or the text
itself where it is a string), content_kind (string, array, other), is_sidechain, cwd, git_branch, version, agent_id,
log_session_id, is_meta, is_compact_summary, slug, summary, has_message, error (why a message can't be loaded, else null).
blocks: session_id, line_no, block_idx, type, text, id, name, input, tool_use_id, result, result_kind, is_error, thinking, raw.
result is a result's string, or the JSON text of any other; result_kind tells which (columns.json_kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions import columns as C
from loomstar.sources import ordered_text

ENTRY = (
    "type string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, gitBranch string, version string, "
    "agentId string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, slug string, summary string, "
    "message struct<role string, model string, content string>"
)
BLOCK = "type string, text string, id string, name string, input string, tool_use_id string, content string, is_error boolean, thinking string"
ISO = r"^\d{4}-\d{2}-\d{2}"
USUAL_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?$"


def timestamp_of(text: Column) -> Column:
    """Null where Python's ISO parser would give up: a date in full is asked for."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def wall_clock(text: Column) -> Column:
    """The time of day and date as written, whatever the offset."""
    return F.try_to_timestamp(F.regexp_replace(F.when(text.rlike(ISO), text), r"(?:Z|[+-]\d{2}:?\d{2})$", ""))


def stem_and_folder(path: Column) -> tuple[Column, Column]:
    """A file's name without its last suffix, and its folder, of a path as Spark writes it."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^file:(?://)?", "")
    return F.url_decode(F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1)), F.url_decode(folder)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session_id (file stem), project_path (its directory), line_no and line of each non-blank line.

    Lines end as for Python's readers, and are numbered from 0 in their file, however many tasks read it.
    """
    stem, folder = stem_and_folder(F.col("path"))
    rows = ordered_text.pieces(spark, paths, files="*.jsonl")
    return rows.select(stem.alias("session_id"), folder.alias("project_path"), F.col("piece").cast("int").alias("line_no"), C.strip(F.col("value")).alias("line")).where("line <> ''")


def wrong_text(block: Column) -> Column:
    """What is wrong with a text block whose text isn't a string, or a thinking block whose thought has no length; else null."""
    type_ = F.try_variant_get(block, "$.type", "string")
    value = {name: F.try_variant_get(block, f"$.{name}", "variant") for name in ("text", "thinking")}
    kind = {name: C.json_kind(v) for name, v in value.items()}
    told = lambda name: F.concat(F.lit(f"the {name} of a block is "), kind[name])
    nothing = F.to_json(value["thinking"]).isin("0", "0.0", "false", "{}")
    text = F.when((type_ == "text") & (kind["text"] != "string"), told("text"))
    return text.when((type_ == "thinking") & kind["thinking"].isin("scalar", "object") & ~nothing, told("thinking"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries of all types; lines that aren't JSON objects are dropped."""
    e = F.from_json("line", ENTRY)
    content = F.col("e.message.content")
    message, ts, said = F.col("e.message"), F.col("e.timestamp"), F.coalesce(F.col("e.type").isin("user", "assistant"), F.lit(False))
    # what isn't as usual is looked at by its type: a message that isn't an object, a time that isn't a text
    odd = F.from_json(F.when(said & (message.isNull() | ~F.coalesce((ts == "") | ts.rlike(ISO), F.lit(True))), F.col("line")), "message variant, timestamp variant")
    kind_of_message, kind_of_time = C.json_kind(odd["message"]), C.json_kind(odd["timestamp"])
    absent = said & message.isNull() & kind_of_message.isNull()  # reads as an empty text
    untimely = kind_of_time.isin("scalar", "array", "object") & ~ts.isin("0", "0.0", "false", "[]", "{}")
    # a text that could be the JSON text of another value is told by the value's type
    unsure = content.rlike(r"^\s*(?:[\[{]|-?\d[\d.eE+-]*\s*$|true\s*$|false\s*$)")
    typed = C.json_kind(F.when(unsure, F.from_json("line", "message struct<content variant>"))["message"]["content"])
    kind = F.when(absent, "string").when(content.isNull(), "other").when(~unsure | (typed == "string"), "string").when(typed == "array", "array").otherwise("other")
    items = F.from_json(F.when(said & (typed == "array") & content.rlike(r'"(?:text|thinking)":[^"]'), content), "array<variant>")
    wrong = F.filter(F.transform(items, wrong_text), lambda x: x.isNotNull())
    error = F.when(said & (kind_of_message != "object"), F.concat(F.lit("the message is "), kind_of_message)).when(untimely, F.concat(F.lit("the timestamp is "), kind_of_time)).otherwise(F.get(wrong, F.lit(0)))
    keep = [c for c in lines.columns if c != "line"]
    rows = lines.where(F.col("line").startswith("{")).withColumn("e", e).where("e.type is not null or e.sessionId is not null or e.slug is not null")
    return rows.select(
        *keep,
        F.col("e.type").alias("type"),
        F.coalesce("e.uuid", F.lit("")).alias("uuid"),
        F.col("e.parentUuid").alias("parent_uuid"),
        F.coalesce("e.timestamp", F.lit("")).alias("ts_text"),
        timestamp_of(F.col("e.timestamp")).alias("ts"),
        F.col("e.message.model").alias("model"),
        F.when(absent, "").otherwise(content).alias("content"),
        kind.alias("content_kind"),
        F.coalesce("e.isSidechain", F.lit(False)).alias("is_sidechain"),
        F.col("e.cwd").alias("cwd"),
        F.col("e.gitBranch").alias("git_branch"),
        F.col("e.version").alias("version"),
        F.col("e.agentId").alias("agent_id"),
        F.col("e.sessionId").alias("log_session_id"),
        F.coalesce("e.isMeta", F.lit(False)).alias("is_meta"),
        F.coalesce("e.isCompactSummary", F.lit(False)).alias("is_compact_summary"),
        F.col("e.slug").alias("slug"),
        F.col("e.summary").alias("summary"),
        (message.isNotNull() | absent).alias("has_message"),
        error.alias("error"),
    )


def read_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_lines(read_lines(spark, paths))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The other form of a transcript: one JSON document {"loglines": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    items = F.from_json(F.get_json_object("value", "$.loglines"), "array<string>")
    stem, folder = stem_and_folder(F.col("_metadata.file_path"))
    return parse_lines(raw.select(stem.alias("session_id"), folder.alias("project_path"), F.posexplode(items).alias("line_no", "line")))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one transcript in either form, by its suffix: .jsonl has lines, any other is one JSON document."""
    return read_entries(spark, path) if path.endswith(".jsonl") else read_document(spark, path)


def messages_only(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("type").isin("user", "assistant"))


def session_errors(entries: DataFrame) -> DataFrame:
    """session_id, project_path, line_no and error of the first message of each session that can't be loaded."""
    error = F.coalesce("error", F.when(~F.col("has_message"), "no message")) if "error" in entries.columns else F.when(~F.col("has_message"), "no message")
    rows = messages_only(entries).withColumn("_error", error).where("_error is not null")
    first = rows.groupBy("session_id").agg(F.min(F.struct("line_no", "project_path", F.col("_error").alias("error"))).alias("f"))
    return first.select("session_id", "f.project_path", "f.line_no", "f.error")


def broken_sessions(entries: DataFrame) -> DataFrame:
    """session_id of sessions with a message that can't be loaded: they are loaded nowhere (session_errors tells why)."""
    return session_errors(entries).select("session_id")


def blocks(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Content blocks that are JSON objects, with their place among all elements and the columns of keep; a string content is one text block."""
    # parsed before they are exploded: a filter on what is parsed after it would parse it once more
    item = F.transform(F.from_json("content", "array<string>"), lambda x: F.struct(x.alias("raw"), F.from_json(F.when(x.startswith("{"), x), BLOCK).alias("b")))
    whole = entries.where("content_kind = 'array'").select("session_id", "line_no", *keep, F.posexplode(item).alias("block_idx", "_item"))
    whole = whole.where("_item.b is not null").select("session_id", "line_no", *keep, "block_idx", "_item.raw", "_item.b")
    kind = C.json_kind(F.from_json(F.when(F.col("b.type") == "tool_result", F.col("raw")), "content variant")["content"])
    return whole.select("session_id", "line_no", *keep, "block_idx", "b.type", "b.text", "b.id", "b.name", "b.input", "b.tool_use_id", F.col("b.content").alias("result"), kind.alias("result_kind"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), "b.thinking", "raw")


def session_metadata(entries: DataFrame) -> DataFrame:
    """The six fields of the entry up to which they are read again: the first with a cwd, else the last."""
    rows = messages_only(entries)
    with_cwd = F.min(F.when(F.col("cwd").isNotNull(), F.col("line_no")))
    fields = F.struct("cwd", "git_branch", "version", "agent_id", "is_sidechain", "log_session_id")
    picked = rows.groupBy("session_id", "project_path").agg(F.min_by(fields, F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("first"), F.max_by(fields, "line_no").alias("last"), with_cwd.alias("cwd_line"))
    m = F.coalesce("first", "last")
    return picked.select("session_id", "project_path", "cwd_line", *[m[c].alias(c) for c in ("cwd", "git_branch", "version", "agent_id", "is_sidechain", "log_session_id")])


def session_summaries(entries: DataFrame, blocks_: DataFrame, size: int = 200) -> DataFrame:
    """session_id, summary: the first summary entry, else the first user text that isn't meta or a tag, else a note."""
    said = entries.where("type = 'summary' and summary <> ''").groupBy("session_id").agg(F.min_by("summary", "line_no").alias("said"))
    texts = message_texts(entries, blocks_).where("type = 'user' and not is_meta and text <> '' and not startswith(text, '<')")
    first = texts.groupBy("session_id").agg(F.min_by("text", "line_no").alias("asked"))
    both = entries.select("session_id").distinct().join(said, "session_id", "left").join(first, "session_id", "left")
    text = F.coalesce("said", "asked", F.lit("(no summary)"))
    return both.select("session_id", F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text).alias("summary"))


def message_texts(entries: DataFrame, blocks_: DataFrame) -> DataFrame:
    """The trimmed text of each entry: its string, or its non-empty text blocks with a space between."""
    ordered = F.array_sort(F.collect_list(F.when((F.col("type") == "text") & (F.col("text") != ""), F.struct("block_idx", "text"))))
    joined = blocks_.groupBy("session_id", "line_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("_joined"))
    text = F.when(F.col("content_kind") == "string", F.col("content")).otherwise(F.coalesce("_joined", F.lit("")))
    return entries.join(joined, ["session_id", "line_no"], "left").withColumn("text", F.trim(text)).drop("_joined")


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """session_id, project, path, modified, size of each transcript below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.jsonl$", "").alias("session_id"), F.element_at(F.split("path", "/"), -2).alias("project"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def find_sessions(files: DataFrame, summaries: DataFrame, include_agents: bool = False, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions by time, the newest first, without warm-ups and unsummarised ones."""
    from loomstar.functions.columns import matches_project

    rows = files.join(summaries, "session_id").where((F.lower("summary") != "warmup") & (F.col("summary") != "(no summary)") & matches_project(F.col("project"), project))
    if not include_agents:
        rows = rows.where(~F.col("session_id").startswith("agent-"))
    rows = rows.orderBy(F.col("modified").desc(), "session_id")
    return rows.limit(limit) if limit else rows


def projects(sessions: DataFrame) -> DataFrame:
    """project, its sessions (newest first) and the time of the newest; projects by that time."""
    item = F.struct("modified", "session_id", "size", "summary")
    return sessions.groupBy("project").agg(F.sort_array(F.collect_list(item), asc=False).alias("sessions"), F.max("modified").alias("newest"), F.count(F.lit(1)).alias("n")).orderBy(F.col("newest").desc(), "project")


def chains(files: DataFrame, entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Resumed sessions by slug: how many, their size, first and last time, and the summary of the newest."""
    slug = entries.where("slug is not null").groupBy("session_id").agg(F.min_by("slug", "line_no").alias("slug"))
    rows = files.join(slug, "session_id").join(summaries, "session_id", "left")
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("size").alias("total_size"), F.min("modified").alias("first_modified"), F.max("modified").alias("last_modified"), F.max_by("summary", F.struct("modified", "session_id")).alias("summary"))


def with_id(block: Column, made: Column) -> Column:
    """A tool call with the id that is made for it, its name, and its input as it was; any other block unchanged."""
    call = F.from_json(block, "type string, id string, name string, input string")
    kind = C.json_kind(F.from_json(block, "input variant")["input"])
    quoted = lambda text: F.to_json(F.array(text))
    bare = lambda text: F.substring(quoted(text), 2, F.length(quoted(text)) - 2)
    given = F.when(kind == "string", bare(call["input"])).when(kind == "null", "null").otherwise(F.coalesce(call["input"], F.lit("{}")))
    text = F.concat(F.lit('{"type":"tool_use","id":'), bare(made), F.lit(',"name":'), bare(F.coalesce(call["name"], F.lit(""))), F.lit(',"input":'), given, F.lit("}"))
    return F.when((call["type"] == "tool_use") & (F.coalesce(call["id"], F.lit("")) == ""), text).otherwise(block)


EXPORTED = "uuid string, name string, summary string, created_at string, updated_at string, chat_messages array<struct<uuid string, text string, content array<string>, sender string, created_at string>>"


def account_conversations(spark: SparkSession, path: str) -> DataFrame:
    """session_no (from 0, in the file's order) and the fields of each conversation of an account's export, which may be one large line."""
    return ordered_text.json_elements(spark, path).select(F.col("nth").alias("session_no"), F.from_json("element", EXPORTED).alias("c")).select("session_no", "c.*")


def listed_conversations(conversations: DataFrame) -> DataFrame:
    """What a list of an export shows: short id, day of the last change, number of messages and name, the last changed first."""
    n = F.coalesce(F.size("chat_messages"), F.lit(0))
    rows = conversations.select("session_no", F.substring("uuid", 1, 8).alias("short_id"), F.substring("updated_at", 1, 10).alias("updated"), n.alias("n_messages"), F.substring(F.coalesce("name", F.lit("(untitled)")), 1, 60).alias("name"), "updated_at")
    return rows.orderBy(F.coalesce("updated_at", F.lit("")).desc(), "session_no").drop("updated_at")


def account_entries(conversations: DataFrame, conversation_ids: list[str] | None = None, include_thinking: bool = True) -> DataFrame:
    """Entries of an export's conversations, with session_no; messages of a repeated conversation id follow those before.

    A tool call without id gets one from its conversation and message.
    """
    if conversation_ids is not None:
        conversations = conversations.where(F.col("uuid").isin(conversation_ids))
    before = Window.partitionBy("uuid").orderBy("session_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.coalesce(F.size("chat_messages"), F.lit(0))).over(before), F.lit(0))
    rows = conversations.withColumn("_before", earlier).select(F.coalesce("uuid", F.lit("")).alias("session_id"), F.col("name").alias("project_path"), F.first("session_no").over(Window.partitionBy("uuid").orderBy("session_no")).alias("session_no"), "_before", F.posexplode("chat_messages").alias("_at", "m"))
    made = F.concat(F.lit("tool_"), F.col("session_id"), F.lit("_"), F.coalesce("m.uuid", F.lit("")))
    block = F.transform(F.filter("m.content", lambda b: b.startswith("{")), lambda b: with_id(b, made))
    if not include_thinking:
        block = F.filter(block, lambda b: F.coalesce(F.get_json_object(b, "$.type"), F.lit("")) != "thinking")
    some = F.coalesce(F.size("m.content"), F.lit(0)) > 0
    content = F.when(some, F.concat(F.lit("["), F.array_join(block, ","), F.lit("]"))).otherwise(F.col("m.text"))
    none, text = F.lit(None).cast("string"), lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "session_id", "project_path", (F.col("_before") + F.col("_at")).cast("int").alias("line_no"), F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("type"), text(F.col("m.uuid")).alias("uuid"), none.alias("parent_uuid"), text(F.col("m.created_at")).alias("ts_text"), timestamp_of(F.col("m.created_at")).alias("ts"), none.alias("model"),
        content.alias("content"), F.when(some, "array").otherwise("string").alias("content_kind"), F.lit(False).alias("is_sidechain"), none.alias("cwd"), none.alias("git_branch"), none.alias("version"), none.alias("agent_id"), F.col("session_id").alias("log_session_id"), F.lit(False).alias("is_meta"), F.lit(False).alias("is_compact_summary"), none.alias("slug"), none.alias("summary"), F.lit(True).alias("has_message"), "session_no",
    )


def account_export(spark: SparkSession, folder: str, conversation_ids: list[str] | None = None, include_thinking: bool = True) -> dict[str, DataFrame]:
    """An account's export: conversations.json, and projects, users, memories where they exist. Gives entries and the others."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    there = {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    if "conversations.json" not in there:
        raise FileNotFoundError(f"{folder}/conversations.json")
    out = {"entries": account_entries(account_conversations(spark, f"{folder}/conversations.json"), conversation_ids, include_thinking)}
    for name in ("projects", "users", "memories"):
        if f"{name}.json" in there:
            out[name] = spark.read.json(f"{folder}/{name}.json", multiLine=True)
    return out

"""Prompts, pages, timelines and search documents of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions import columns as C
from loomstar.functions import fixed
from loomstar.functions.arrow import as_python_json, as_python_str
from loomstar.sources import transcripts

UP_TO_HERE = (Window.unboundedPreceding, 0)


def segments(texts: DataFrame) -> DataFrame:
    """Entries with conversation (from 1) and page: each user text starts a conversation; what precedes the first is dropped.

    texts: entries with text (transcripts.message_texts).
    """
    by = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(*UP_TO_HERE)
    prompt = (F.col("type") == "user") & (F.col("text") != "")
    rows = texts.withColumn("is_prompt", prompt).withColumn("conversation", F.sum(prompt.cast("int")).over(by).cast("int")).where("conversation > 0")
    return rows.withColumn("page", (F.floor((F.col("conversation") - 1) / fixed.PROMPTS_PER_PAGE) + 1).cast("int"))


def prompt_numbers(segmented: DataFrame) -> DataFrame:
    """Prompts with the number of the prompt that they continue: a summary of compacted context goes to the one before."""
    by = Window.partitionBy("session_id").orderBy("conversation").rowsBetween(*UP_TO_HERE)
    rows = segmented.where("is_prompt")
    return rows.withColumn("prompt", F.sum((~F.col("is_compact_summary")).cast("int")).over(by).cast("int"))


def analysis(segmented: DataFrame, blocks: DataFrame) -> DataFrame:
    """session_id, conversation, tool_counts (array of n, tool), tool_stats, long_texts, commits (hash, message, ts_text)."""
    rows = blocks.join(segmented.select("session_id", "line_no", "conversation", "ts_text"), ["session_id", "line_no"])
    tools = rows.where("type = 'tool_use'").groupBy("session_id", "conversation", F.coalesce("name", F.lit("Unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    tools = tools.groupBy("session_id", "conversation").agg(F.array_sort(F.collect_list(F.struct("n", "tool"))).alias("tool_counts"))
    longs = rows.where((F.col("type") == "text") & (F.length("text") >= fixed.LONG_TEXT)).groupBy("session_id", "conversation").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "block_idx", "text"))), lambda x: x["text"]).alias("long_texts"))
    made = commit_rows(rows).groupBy("session_id", "conversation").agg(F.array_sort(F.collect_list(F.struct("ts_text", "hash", "message"))).alias("commits"))
    every = segmented.select("session_id", "conversation").distinct()
    for part in (tools, longs, made):
        every = every.join(part, ["session_id", "conversation"], "left")
    return every.withColumn("tool_stats", C.tool_stats(F.coalesce("tool_counts", F.array().cast("array<struct<n:bigint,tool:string>>"))))


def commit_rows(placed_blocks: DataFrame) -> DataFrame:
    return placed_blocks.where("type = 'tool_result' and result_kind = 'string'").select("session_id", "conversation", "ts_text", F.explode(C.commits(F.col("result"))).alias("c")).select("session_id", "conversation", "ts_text", "c.hash", "c.message")


def timeline(segmented: DataFrame, blocks: DataFrame) -> DataFrame:
    """session_id, ts_text, kind (prompt or commit), content, conversation, page; in the order of their times."""
    prompts = prompt_numbers(segmented).where("not is_compact_summary and not startswith(text, 'Stop hook feedback:')").select("session_id", "ts_text", F.lit("prompt").alias("kind"), F.col("text").alias("content"), "conversation", "page")
    placed = blocks.join(segmented.select("session_id", "line_no", "conversation", "page", "ts_text"), ["session_id", "line_no"])
    made = placed.where("type = 'tool_result' and result_kind = 'string'").select("session_id", "ts_text", "conversation", "page", F.explode(C.commits(F.col("result"))).alias("c"))
    commits = made.select("session_id", "ts_text", F.lit("commit").alias("kind"), F.concat("c.hash", F.lit(" "), "c.message").alias("content"), "conversation", "page")
    return prompts.unionByName(commits).orderBy("session_id", "ts_text", "conversation", "kind", "content")


def search_documents(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a search index holds: texts, tool inputs and outputs with the page they are on.

    Every user entry counts for the page here, with a text or without.
    """
    by = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(*UP_TO_HERE)
    users = F.sum((F.col("type") == "user").cast("int")).over(by)
    page = F.greatest(F.lit(1), F.floor((users - 1) / fixed.PROMPTS_PER_PAGE) + 1).cast("int")
    rows = transcripts.messages_only(entries).withColumn("page", page).select("session_id", "project_path", "line_no", F.col("type").alias("role"), "ts_text", "content", "content_kind", "page")
    strings = rows.where("role = 'user' and content_kind = 'string'").select("session_id", "project_path", "line_no", F.lit(0).alias("block_idx"), "ts_text", "page", F.lit("user").alias("type"), "content")
    placed = blocks.join(rows.drop("content"), ["session_id", "line_no"])
    use = F.col("type") == "tool_use"
    kind_of_input = C.json_kind(F.from_json(F.when(use, F.col("raw")), "input variant")["input"])
    object_, other = use & (F.coalesce(kind_of_input, F.lit("object")) == "object"), use & kind_of_input.isin("array", "scalar", "null")
    given = F.when(object_, as_python_json(F.when(object_, F.coalesce("input", F.lit("{}"))))).when(other, as_python_str(F.when(other, F.coalesce("input", F.lit("null"))))).otherwise(F.col("input"))
    text = F.when(F.col("type") == "text", F.col("text")).when((F.col("type") == "tool_result") & (F.col("role") == "user") & (F.col("result_kind") == "string"), F.substring("result", 1, 500)).when((F.col("type") == "tool_use") & (F.col("role") == "assistant"), F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.substring(given, 1, 1000)))
    kind = F.when(F.col("type") == "text", F.col("role")).otherwise(F.col("type"))
    parts = placed.withColumn("content", text).select("session_id", "project_path", "line_no", "block_idx", "ts_text", "page", kind.alias("type"), "content")
    docs = strings.unionByName(parts).withColumn("content", F.regexp_replace("content", r"^[\s]+|[\s]+$", "")).where("content <> ''")
    anchor, name = C.message_anchor(F.col("ts_text")), F.format_string("page-%03d", "page")
    return docs.select(F.concat(C.file_name(F.col("project_path")), F.lit("/"), "session_id", F.lit("/"), name, F.lit("#"), anchor).alias("id"), "session_id", F.concat(name, F.lit(".html")).alias("page_file"), anchor.alias("anchor"), "type", F.col("ts_text").alias("timestamp"), "content", C.snippet(F.col("content")).alias("snippet"))


def search(documents: DataFrame, query: str, limit: int = 100, order: tuple[str, ...] = ("id", "content")) -> DataFrame:
    """Documents that hold every word of the query, ignoring case, with a snippet around the query or its first word."""
    first = query.split()[0] if query.split() else query
    whole = F.contains(F.lower("content"), F.lit(query.lower()))
    around = F.when(whole, C.snippet(F.col("content"), F.lit(query))).otherwise(C.snippet(F.col("content"), F.lit(first)))
    return documents.where(C.matches_terms(F.col("content"), query)).withColumn("snippet", around).orderBy(*order).limit(limit)


def repositories(blocks: DataFrame) -> DataFrame:
    """session_id and the repository named by the first push of each session."""
    found = blocks.where("type = 'tool_result' and result_kind = 'string'").withColumn("repository", C.repository(F.col("result"))).where("repository is not null")
    return found.groupBy("session_id").agg(F.min_by("repository", F.struct("line_no", "block_idx")).alias("repository"))

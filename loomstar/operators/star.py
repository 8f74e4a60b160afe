"""The star schema: dimensions and facts from entries and blocks, and the pre-joined views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions import columns as C
from loomstar.functions import fixed
from loomstar.functions.arrow import MAY_NAME, as_python_json, as_python_str, as_python_texts, entity_mentions
from loomstar.operators import links
from loomstar.sources import transcripts

DIMENSIONS = ["dim_tool", "dim_model", "dim_project", "dim_session", "dim_date", "dim_time", "dim_message_type", "dim_content_block_type", "dim_file", "dim_programming_language", "dim_error_type", "dim_entity_type", "dim_intent", "dim_topic", "dim_sentiment"]
FACTS = ["fact_messages", "fact_content_blocks", "fact_tool_calls", "fact_session_summary", "fact_file_operations", "fact_code_blocks", "fact_errors", "fact_entity_mentions", "fact_tool_chain_steps", "fact_message_enrichment", "fact_message_topics", "fact_session_insights"]
EMPTY = {
    "fact_message_enrichment": "enrichment_id string, message_id string, session_key string, intent_key string, sentiment_key string, complexity_score float, confidence_score float, enrichment_model string, enriched_at timestamp",
    "fact_message_topics": "message_topic_id string, message_id string, topic_key string, relevance_score float",
    "fact_session_insights": "insight_id string, session_key string, summary_text string, key_decisions string, outcome_status string, task_completed boolean, primary_intent_key string, complexity_score float, enrichment_model string, enriched_at timestamp",
    "stg_raw_messages": "session_id string, project_name string, project_path string, message_id string, parent_id string, message_type string, timestamp timestamp, model string, cwd string, git_branch string, version string, content_json string, content_text string",
}


def seeds(spark: SparkSession) -> dict[str, DataFrame]:
    """The dimensions whose rows are given. Spark doesn't know how few they are and would rather broadcast a fact that compresses well."""
    key, one = C.dimension_key, lambda rows, kind: F.broadcast(spark.createDataFrame(rows, kind))
    return {
        "dim_message_type": one([(x,) for x in fixed.MESSAGE_TYPES], "message_type string").select(key(F.col("message_type")).alias("message_type_key"), "message_type"),
        "dim_content_block_type": one([(x,) for x in fixed.BLOCK_TYPES], "block_type string").select(key(F.col("block_type")).alias("content_block_type_key"), "block_type"),
        "dim_entity_type": one([(x,) for x in fixed.ENTITY_TYPES], "entity_type string").select(key(F.col("entity_type")).alias("entity_type_key"), "entity_type", F.lit("regex").alias("extraction_method")),
        "dim_intent": one(fixed.INTENTS, "intent_name string, intent_category string, description string").select(key(F.col("intent_name")).alias("intent_key"), "intent_name", "intent_category", "description"),
        "dim_topic": one(fixed.TOPICS, "topic_name string, topic_category string").select(key(F.col("topic_name")).alias("topic_key"), "topic_name", "topic_category"),
        "dim_sentiment": one(fixed.SENTIMENTS, "sentiment_name string, valence float").select(key(F.col("sentiment_name")).alias("sentiment_key"), "sentiment_name", "valence"),
        "dim_error_type": one([("tool_error", "execution")], "error_type string, error_category string").select(key(F.col("error_type")).alias("error_type_key"), "error_type", "error_category"),
    }


def seconds(later: Column, earlier: Column) -> Column:
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / 1e6).cast("float")


class Star:
    """The tables of a star schema over entries (see sources.transcripts), each a lazy DataFrame.

    Sessions with a broken entry are left out whole. truncate: characters of texts that are kept; thinking: whether
    blocks of that kind are listed; keep: what several tables are made of (entries, their texts, blocks, tool calls) is
    written once to the folder that executors share and read from there, so that transcripts are parsed once.
    """

    def __init__(self, entries: DataFrame, truncate: int = fixed.TRUNCATE, thinking: bool = True, keep: bool = False):
        self.spark, self.truncate, self.thinking, self.keep = entries.sparkSession, truncate, thinking, keep
        said = self.kept_once(transcripts.messages_only(entries), "entries")
        broken = transcripts.broken_sessions(said)
        if keep and broken.limit(1).count() == 0:
            self.entries = said
        else:
            self.entries = self.kept_once(said.join(broken, "session_id", "left_anti"), "entries")
        self.extra: dict[str, DataFrame] = {}

    def kept_once(self, df: DataFrame, name: str) -> DataFrame:
        return links.cut(df, name) if self.keep else df

    @cached_property
    def keyed(self) -> DataFrame:
        """Entries with their keys. Date and time are those written, not those of UTC."""
        text = F.col("ts_text")
        wall = transcripts.wall_clock(text)
        ok, usual = F.col("ts").isNotNull(), text.rlike(transcripts.USUAL_TIME)  # where the digits stand is known then
        day = F.when(usual, F.translate(F.substring(text, 1, 10), "-", "").cast("int")).otherwise(C.date_key(wall))
        minute = F.when(usual, F.concat(F.substring(text, 12, 2), F.substring(text, 15, 2)).cast("int")).otherwise(C.time_key(wall))
        return self.entries.withColumn("session_key", C.dimension_key(F.col("session_id"))).withColumn("project_key", C.dimension_key(F.col("project_path"))).withColumn("date_key", F.when(ok, day)).withColumn("time_key", F.when(ok, minute))

    @cached_property
    def placed(self) -> DataFrame:
        """Blocks with the message they stand in; of uses the input as Python writes it, of results their text."""
        more = [c for c in ("session_no",) if c in self.entries.columns]
        own = self.keyed.select("session_id", "line_no", "content", "content_kind", "session_key", F.col("uuid").alias("message_id"), "ts", "date_key", "time_key", F.col("type").alias("message_type"), *more)
        rows = transcripts.blocks(own, ("session_key", "message_id", "ts", "date_key", "time_key", "message_type", *more))
        # lists of texts are joined here; what needs Python's way to write a value goes there
        items = F.from_json(F.when(F.col("result_kind") == "array", F.col("result")), "array<variant>")
        objects = F.filter(items, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
        kinds = F.transform(objects, lambda x: C.json_kind(F.try_variant_get(x, "$.text", "variant")))
        plain = F.forall(kinds, lambda k: F.coalesce(k, F.lit("string")) == "string")
        joined = F.array_join(F.transform(objects, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), " ")
        kind, other = F.col("result_kind"), F.col("result_kind").isin("object", "scalar", "null")
        text = F.when(kind == "string", F.col("result")).when(plain, joined).when(kind == "array", as_python_texts(F.when(~plain, F.col("result"))))
        text = F.coalesce(text.when(other, as_python_str(F.when(other, F.coalesce("result", F.lit("null"))))), F.lit(""))
        use = F.col("type") == "tool_use"
        told = C.json_kind(F.from_json(F.when(use & F.col("input").isNull(), F.col("raw")), "input variant")["input"])  # null, or not there
        given = F.when(use, F.coalesce("input", F.when(told == "null", "null"), F.lit("{}")))
        return self.kept_once(rows.withColumn("full_output", F.when(F.col("type") == "tool_result", text)).withColumn("input_json", as_python_json(given)), "blocks")

    @property
    def blocks(self) -> DataFrame:
        return self.placed

    @cached_property
    def texts(self) -> DataFrame:
        """Entries with their text, and what their blocks are."""
        items = F.filter(F.when(F.col("content_kind") == "array", F.from_json("content", "array<string>")), lambda x: x.startswith("{"))
        none = F.array().cast("array<struct<type:string,text:string>>")
        parsed = F.filter(F.transform(items, lambda x: F.from_json(x, "type string, text string")), lambda b: b.isNotNull())
        rows = self.keyed.withColumn("_b", F.coalesce(parsed, none))
        kind = lambda t: F.exists("_b", lambda b: F.coalesce(b["type"], F.lit("")) == t)
        text = F.array_join(F.transform(F.filter("_b", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
        string = F.col("content_kind") == "string"
        rows = rows.withColumn("full_text", F.when(string, F.col("content")).otherwise(text)).withColumn("content_block_count", F.when(string, 1).otherwise(F.size("_b")))
        return self.kept_once(rows.withColumn("has_tool_use", kind("tool_use")).withColumn("has_tool_result", kind("tool_result")).withColumn("has_thinking", kind("thinking")).drop("_b"), "texts")

    @cached_property
    def response_times(self) -> DataFrame:
        """session_id, line_no, response_time_seconds: since the latest earlier row of the parent that has a time."""
        base = self.entries.select("session_id", "line_no", "uuid", "parent_uuid", "ts")
        sides = base.where("ts is not null").select("session_id", F.col("uuid").alias("_key"), "line_no", F.lit(True).alias("_is"), "ts").unionByName(base.where("parent_uuid <> '' and ts is not null").select("session_id", F.col("parent_uuid").alias("_key"), "line_no", F.lit(False).alias("_is"), "ts"))
        found = links.latest_before(sides, ["session_id", "_key"], ["line_no", "_is"], "_is", "ts", "_then").where("not _is and _then is not null")
        return found.select("session_id", "line_no", seconds(F.col("ts"), F.col("_then")).alias("response_time_seconds"))

    @cached_property
    def message_measures(self) -> DataFrame:
        """fact_messages without the depth, which takes rounds of joins."""
        first_cwd = F.min(F.when(F.col("cwd").isNotNull(), F.col("line_no"))).over(Window.partitionBy("session_id"))
        seen = F.last(F.when(F.col("line_no") <= F.coalesce("_cwd_line", F.lit(2**31 - 1)), F.col("is_sidechain")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
        rows = self.texts.withColumn("_cwd_line", first_cwd).withColumn("_side", seen).join(self.response_times.hint("merge"), ["session_id", "line_no"], "left")
        json = F.when(F.col("content_kind") == "string", F.to_json(F.array("content"))).otherwise(F.concat(F.lit("["), F.coalesce("content", F.lit("null")), F.lit("]")))
        return rows.select(
            F.col("uuid").alias("message_id"), "session_key", "project_key", C.dimension_key(F.col("type")).alias("message_type_key"),
            F.when(F.col("model") != "", C.dimension_key(F.col("model"))).alias("model_key"), "date_key", "time_key", F.col("parent_uuid").alias("parent_message_id"), F.col("ts").alias("timestamp"),
            F.length("full_text").alias("content_length"), "content_block_count", "has_tool_use", "has_tool_result", "has_thinking",
            C.word_count(F.col("full_text")).alias("word_count"), C.estimated_tokens(F.col("full_text")).alias("estimated_tokens"), "response_time_seconds",
            F.substring("full_text", 1, self.truncate).alias("content_text"), F.substring(json, 2, F.length(json) - 2).alias("content_json"), F.col("_side").alias("is_sidechain"), "session_id", "line_no",
        )

    @cached_property
    def fact_messages(self) -> DataFrame:
        depth = links.depths(self.entries, "session_id", "line_no", "uuid", "parent_uuid")
        rows = self.message_measures.join(depth.hint("merge"), ["session_id", "line_no"])  # a row for each message: never through the driver
        order = ["message_id", "session_key", "project_key", "message_type_key", "model_key", "date_key", "time_key", "parent_message_id", "timestamp", "content_length", "content_block_count", "has_tool_use", "has_tool_result", "has_thinking", "word_count", "estimated_tokens", "response_time_seconds", "conversation_depth", "content_text", "content_json", "is_sidechain"]
        return rows.select(*order)

    @cached_property
    def uses(self) -> DataFrame:
        """Tool calls as they were made."""
        rows = self.placed.where("type = 'tool_use'").withColumn("tool_name", F.coalesce("name", F.lit("unknown")))
        return rows.withColumn("tool_key", C.dimension_key(F.col("tool_name"))).withColumn("input_summary", F.substring("input_json", 1, self.truncate))

    @cached_property
    def results(self) -> DataFrame:
        return self.placed.where("type = 'tool_result'")

    @cached_property
    def fact_tool_calls(self) -> DataFrame:
        """Each result with the latest earlier use of its id in the session; uses without a result aren't calls."""
        made = F.struct("message_id", "ts", "date_key", "time_key", "tool_key", "input_json", "input_summary")
        use = self.uses.select("session_id", "session_key", F.col("id").alias("tool_call_id"), "line_no", "block_idx", F.lit(True).alias("_is"), made.alias("_use"))
        result = self.results.where("tool_use_id <> ''").select("session_id", "session_key", F.col("tool_use_id").alias("tool_call_id"), "line_no", "block_idx", F.lit(False).alias("_is"), F.struct("message_id", "full_output", "is_error").alias("_result"))
        both = use.unionByName(result, allowMissingColumns=True)
        rows = links.latest_before(both, ["session_id", "tool_call_id"], ["line_no", "block_idx"], "_is", "_use", "_made").where("not _is and _made is not null")
        calls = rows.select(
            "tool_call_id", "session_key", "_made.tool_key", "_made.date_key", "_made.time_key", F.col("_made.message_id").alias("invoke_message_id"), F.col("_result.message_id").alias("result_message_id"), F.col("_made.ts").alias("timestamp"),
            F.length("_made.input_json").alias("input_char_count"), F.length("_result.full_output").alias("output_char_count"), F.col("_result.is_error").alias("is_error"), "_made.input_json", "_made.input_summary", F.substring("_result.full_output", 1, self.truncate).alias("output_text"),
        )
        return self.kept_once(calls, "tool_calls")

    @cached_property
    def fact_errors(self) -> DataFrame:
        rows = self.fact_tool_calls.where("is_error")
        return rows.select(F.concat("tool_call_id", F.lit("-error")).alias("error_id"), "tool_call_id", "session_key", "tool_key", C.dimension_key(F.lit("tool_error")).alias("error_type_key"), "date_key", "time_key", F.col("output_text").alias("error_message"), "timestamp")

    @cached_property
    def fact_tool_chain_steps(self) -> DataFrame:
        by = Window.partitionBy("session_id").orderBy("line_no", "block_idx")
        rows = self.uses.withColumn("step_position", F.row_number().over(by) - 1).withColumn("_tool", F.lag("tool_key").over(by)).withColumn("_ts", F.lag("ts").over(by))
        chain = F.concat("session_key", F.lit("-chain"))
        return rows.select(F.concat(chain, F.lit("-"), F.col("step_position").cast("string")).alias("chain_step_id"), "session_key", chain.alias("chain_id"), F.col("id").alias("tool_call_id"), "tool_key", "step_position", F.when(F.col("ts").isNotNull(), F.col("_tool")).alias("prev_tool_key"), seconds(F.col("ts"), F.col("_ts")).alias("time_since_prev_seconds"))

    @cached_property
    def _file_uses(self) -> DataFrame:
        keys = F.json_object_keys("input")
        path = F.lit(None).cast("string")
        for k in reversed(["file_path", "path", "filepath", "notebook_path"]):
            path = F.when(F.array_contains(keys, k), F.get_json_object("input", f"$.{k}")).otherwise(path)
        return self.uses.withColumn("file_path", path).where("file_path <> ''")

    @cached_property
    def fact_file_operations(self) -> DataFrame:
        own = F.try_variant_get(F.try_parse_json("input"), "$.content", "variant")  # what isn't a string has no size
        content = F.when(C.json_kind(own) == "string", F.try_variant_get(own, "$", "string")).otherwise("")
        return self._file_uses.select(F.concat("id", F.lit("-file")).alias("file_operation_id"), F.col("id").alias("tool_call_id"), "session_key", C.dimension_key(F.col("file_path")).alias("file_key"), "tool_key", "date_key", "time_key", C.operation_type(F.col("tool_name")).alias("operation_type"), F.length(content).alias("file_size_chars"), F.col("ts").alias("timestamp"))

    @cached_property
    def fact_content_blocks(self) -> DataFrame:
        kinds = ["text", "tool_use", "tool_result", "thinking", "image"]
        listed = self.placed.where(F.col("type").isin(kinds) & (F.lit(self.thinking) | (F.col("type") != "thinking")))
        cut = lambda x: F.substring(x, 1, self.truncate)
        text = F.when(F.col("type") == "text", F.coalesce("text", F.lit(""))).when(F.col("type") == "thinking", F.coalesce("thinking", F.lit(""))).when(F.col("type") == "tool_use", cut(F.col("input_json"))).when(F.col("type") == "tool_result", cut(F.col("full_output"))).otherwise("[image]")
        arrays = listed.withColumn("_text", text).select("message_id", "session_key", F.col("type").alias("_type"), "date_key", "time_key", F.col("block_idx").alias("block_index"), F.when(F.col("type") == "image", 0).otherwise(F.length("_text")).alias("content_length"), cut(F.col("_text")).alias("content_text"), F.when(F.col("type") == "image", F.lit('{"type": "image", "note": "content omitted"}')).otherwise(F.col("raw")).alias("content_json"))
        strings = self.keyed.where("content_kind = 'string'").select(F.col("uuid").alias("message_id"), "session_key", F.lit("text").alias("_type"), "date_key", "time_key", F.lit(0).alias("block_index"), F.length("content").alias("content_length"), cut(F.col("content")).alias("content_text"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content_json"))
        rows = arrays.unionByName(strings)
        return rows.select(F.concat("message_id", F.lit("-"), F.col("block_index").cast("string")).alias("content_block_id"), "message_id", "session_key", C.dimension_key(F.col("_type")).alias("content_block_type_key"), "date_key", "time_key", "block_index", "content_length", "content_text", "content_json")

    @cached_property
    def code(self) -> DataFrame:
        rows = self.texts.where(F.contains("full_text", F.lit("```")))
        return rows.select(F.col("uuid").alias("message_id"), "session_key", "date_key", "time_key", F.posexplode(C.code_blocks(F.col("full_text"))).alias("block_index", "b"))

    @cached_property
    def fact_code_blocks(self) -> DataFrame:
        return self.code.select(F.concat("message_id", F.lit("-code-"), F.col("block_index").cast("string")).alias("code_block_id"), "message_id", "session_key", C.dimension_key(F.col("b.language")).alias("language_key"), "date_key", "time_key", "block_index", C.line_count(F.col("b.code")).alias("line_count"), F.length("b.code").alias("char_count"), F.substring("b.code", 1, self.truncate).alias("code_text"))

    @cached_property
    def fact_entity_mentions(self) -> DataFrame:
        rows = self.texts.where(F.col("full_text").rlike(MAY_NAME)).select(F.col("uuid").alias("message_id"), "session_key", F.explode(entity_mentions("full_text")).alias("m"))
        key = C.dimension_key(F.col("message_id"), F.col("m.entity_type"), F.col("m.position_start"))
        return rows.select(key.alias("mention_id"), "message_id", "session_key", C.dimension_key(F.col("m.entity_type")).alias("entity_type_key"), "m.entity_text", F.lower("m.entity_text").alias("entity_normalized"), "m.context_snippet", "m.position_start", "m.position_end")

    @cached_property
    def fact_session_summary(self) -> DataFrame:
        """First and last times are those of the file's order, so a duration may be negative."""
        timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
        per = self.keyed.groupBy("session_id", "session_key", "project_key").agg(F.count(F.lit(1)).cast("int").alias("total_messages"), F.count_if(F.col("type") == "user").cast("int").alias("user_messages"), F.count_if(F.col("type") == "assistant").cast("int").alias("assistant_messages"), F.count_if(F.col("content_kind") == "string").alias("_strings"), F.min_by(F.struct("ts", "date_key"), timed).alias("_first"), F.max_by("ts", timed).alias("last_timestamp"))
        shown = F.col("type").isin("text", "tool_use", "tool_result", "image") | ((F.col("type") == "thinking") & F.lit(self.thinking))
        of = self.blocks.groupBy("session_id").agg(F.count_if(F.col("type") == "thinking").alias("_think"), F.count_if(shown).alias("_blocks"))
        calls = self.fact_tool_calls.groupBy("session_key").agg(F.count(F.lit(1)).alias("_calls"))
        rows = per.join(of, "session_id", "left").join(calls, "session_key", "left")
        n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        length = ((F.unix_micros("last_timestamp") - F.unix_micros("_first.ts")) / 1e6).cast("int")
        return rows.select("session_key", "project_key", F.col("_first.date_key").alias("date_key"), "total_messages", "user_messages", "assistant_messages", n(F.col("_calls")).alias("total_tool_calls"), n(F.col("_think")).alias("total_thinking_blocks"), n(F.coalesce("_blocks", F.lit(0)) + F.col("_strings")).alias("total_content_blocks"), n(length).alias("session_duration_seconds"), F.col("_first.ts").alias("first_timestamp"), "last_timestamp")

    @cached_property
    def dim_tool(self) -> DataFrame:
        return self.uses.select("tool_key", "tool_name").distinct().withColumn("tool_category", C.tool_category(F.col("tool_name")))

    @cached_property
    def dim_model(self) -> DataFrame:
        return self.entries.where("model <> ''").select(F.col("model").alias("model_name")).distinct().select(C.dimension_key(F.col("model_name")).alias("model_key"), "model_name", C.model_family(F.col("model_name")).alias("model_family"))

    @cached_property
    def dim_project(self) -> DataFrame:
        return self.entries.select("project_path").distinct().select(C.dimension_key(F.col("project_path")).alias("project_key"), "project_path", C.file_name(F.col("project_path")).alias("project_name"))

    @cached_property
    def dim_session(self) -> DataFrame:
        timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
        times = self.entries.groupBy("session_id").agg(F.min_by("ts", timed).alias("first_timestamp"), F.max_by("ts", timed).alias("last_timestamp"))
        meta = transcripts.session_metadata(self.entries).join(times, "session_id")
        agent = F.col("agent_id").isNotNull()
        return meta.select(C.dimension_key(F.col("session_id")).alias("session_key"), "session_id", C.dimension_key(F.col("project_path")).alias("project_key"), "cwd", "git_branch", "version", "first_timestamp", "last_timestamp", agent.alias("is_agent"), "agent_id", F.when(agent & F.col("log_session_id").isNotNull(), C.dimension_key(F.col("log_session_id"))).alias("parent_session_key"), F.lit(0).alias("depth_level"))

    @cached_property
    def dim_date(self) -> DataFrame:
        d = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
        rows = self.keyed.where("date_key is not null").select("date_key").distinct().withColumn("full_date", d)
        weekday = F.weekday("full_date")
        return rows.select("date_key", "full_date", F.year("full_date").alias("year"), F.month("full_date").alias("month"), F.day("full_date").alias("day"), weekday.alias("day_of_week"), F.date_format("full_date", "EEEE").alias("day_name"), F.date_format("full_date", "MMMM").alias("month_name"), F.quarter("full_date").alias("quarter"), (weekday >= 5).alias("is_weekend"))

    @cached_property
    def dim_time(self) -> DataFrame:
        hour = F.floor(F.col("time_key") / 100).cast("int")
        return self.keyed.where("time_key is not null").select("time_key").distinct().select("time_key", hour.alias("hour"), (F.col("time_key") % 100).alias("minute"), C.time_of_day(hour).alias("time_of_day"))

    @cached_property
    def dim_file(self) -> DataFrame:
        p = F.col("file_path")
        return self._file_uses.select("file_path").distinct().select(C.dimension_key(p).alias("file_key"), "file_path", C.file_name(p).alias("file_name"), C.file_extension(p).alias("file_extension"), C.directory_path(p).alias("directory_path"))

    @cached_property
    def dim_programming_language(self) -> DataFrame:
        extensions = {k: ",".join(v) for k, v in fixed.LANGUAGE_EXTENSIONS.items()}
        name = F.col("b.language")
        return self.code.select(name.alias("language_name")).distinct().select(C.dimension_key(F.col("language_name")).alias("language_key"), "language_name", C.lookup(F.col("language_name"), extensions, "").alias("file_extensions"))

    @cached_property
    def _seeds(self) -> dict[str, DataFrame]:
        return seeds(self.spark)

    def table(self, name: str) -> DataFrame:
        if name in self.extra:
            return self.extra[name]
        if name in EMPTY:
            return self.spark.createDataFrame([], EMPTY[name])
        return self._seeds[name] if name in self._seeds else getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in [*DIMENSIONS, *FACTS, "stg_raw_messages"]}

    def views(self) -> dict[str, DataFrame]:
        return views({n: self.table(n) for n in [*DIMENSIONS, *FACTS]})

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables and of the pre-joined ones."""
        for name, df in {**self.tables(), **self.views()}.items():
            df.createOrReplaceTempView(prefix + name)


def sessions_view(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["fact_session_summary"].alias("f").join(t["dim_session"].alias("s"), "session_key").join(t["dim_project"].alias("p"), F.col("f.project_key") == F.col("p.project_key")).join(t["dim_date"].alias("d"), "date_key", "left")
    return rows.select("s.session_id", "s.cwd", "s.git_branch", "s.version", "s.first_timestamp", "s.last_timestamp", "p.project_name", "p.project_path", "f.total_messages", "f.user_messages", "f.assistant_messages", "f.total_tool_calls", "f.total_thinking_blocks", "f.session_duration_seconds", "d.full_date", "d.day_name", "d.month_name", "d.year", "d.is_weekend")


def messages_view(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["fact_messages"].alias("f").join(t["dim_message_type"].alias("k"), "message_type_key").join(t["dim_model"].alias("m"), "model_key", "left").join(t["dim_session"].alias("s"), "session_key").join(t["dim_project"].alias("p"), F.col("f.project_key") == F.col("p.project_key"), "left").join(t["dim_date"].alias("d"), "date_key", "left").join(t["dim_time"].alias("c"), "time_key", "left")
    return rows.select("f.message_id", "f.timestamp", "f.content_text", "f.content_length", "f.word_count", "f.estimated_tokens", "f.has_tool_use", "f.has_thinking", "f.response_time_seconds", "f.conversation_depth", "k.message_type", "m.model_name", "m.model_family", "s.session_id", "s.cwd", "p.project_name", "d.full_date", "d.day_name", "c.hour", "c.time_of_day")


def tool_calls_view(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["fact_tool_calls"].alias("f").join(t["dim_tool"].alias("o"), "tool_key").join(t["dim_session"].alias("s"), "session_key").join(t["dim_project"].alias("p"), F.col("s.project_key") == F.col("p.project_key"), "left").join(t["dim_date"].alias("d"), "date_key", "left").join(t["dim_time"].alias("c"), "time_key", "left")
    return rows.select("f.tool_call_id", "f.timestamp", "f.input_char_count", "f.output_char_count", "f.is_error", "f.input_summary", "f.output_text", "o.tool_name", "o.tool_category", "s.session_id", "s.cwd", "p.project_name", "d.full_date", "c.hour", "c.time_of_day")


def file_operations_view(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["fact_file_operations"].alias("f").join(t["dim_file"].alias("x"), "file_key").join(t["dim_tool"].alias("o"), "tool_key").join(t["dim_session"].alias("s"), "session_key").join(t["dim_project"].alias("p"), F.col("s.project_key") == F.col("p.project_key"), "left")
    return rows.select("f.operation_type", "f.file_size_chars", "f.timestamp", "x.file_path", "x.file_name", "x.file_extension", "x.directory_path", "o.tool_name", "o.tool_category", "s.session_id", "p.project_name")


VIEWS = {"semantic_sessions": sessions_view, "semantic_messages": messages_view, "semantic_tool_calls": tool_calls_view, "semantic_file_operations": file_operations_view}


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: make(tables) for name, make in VIEWS.items()}

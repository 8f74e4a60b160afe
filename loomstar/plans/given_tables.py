"""The given tables as transcripts, so that every operator runs on them.

A conversation is a session of string messages; what a user did (events) is a session of tool calls, each an assistant
entry with the use and a user entry two seconds later with its result. The JSON text of contents is made here and
parsed by the transcript operators, as with files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions.columns import lookup
from loomstar.operators.links import cut
from loomstar.operators.star import Star

TOOL_OF_EVENT = {"view": "Read", "click": "Edit", "purchase": "Write", "signup": "Bash", "error": "Grep"}
MODELS = ["m-opus-1", "m-sonnet-2", "m-haiku-1", "m-other"]
EXTENSIONS = [".py", ".js", ".md", ".sql"]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(rows: DataFrame) -> DataFrame:
    none, no = F.lit(None).cast("string"), F.lit(False)
    own = {"parent_uuid": none, "model": none, "is_sidechain": no, "cwd": F.lit("/data"), "git_branch": F.lit("main"), "version": F.lit("1"), "agent_id": none, "log_session_id": F.col("session_id"), "is_meta": no, "is_compact_summary": no, "slug": none, "summary": none, "has_message": F.lit(True)}
    rows = rows.withColumns({k: v for k, v in own.items() if k not in rows.columns})
    order = ["session_id", "project_path", "line_no", "type", "uuid", "parent_uuid", "ts_text", "ts", "model", "content", "content_kind", "is_sidechain", "cwd", "git_branch", "version", "agent_id", "log_session_id", "is_meta", "is_compact_summary", "slug", "summary", "has_message"]
    return rows.select(*order)


def conversation_entries(conversations: DataFrame) -> DataFrame:
    kept = F.col("role").isin("user", "assistant")
    uuid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.last(F.when(kept, uuid), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 7919 + F.col("turn") * 37)
    model = F.when(F.col("role") == "assistant", F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % 4 + 1).cast("int")))
    return _entries(
        conversations.select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("/data/p"), (F.col("conv_id") % 7).cast("string")).alias("project_path"), F.col("turn").cast("int").alias("line_no"), F.col("role").alias("type"),
            uuid.alias("uuid"), parent.alias("parent_uuid"), F.date_format(ts, ISO).alias("ts_text"), ts.alias("ts"), model.alias("model"), F.col("text").alias("content"), F.lit("string").alias("content_kind"),
        )
    )


def event_entries(events: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    name = lookup(F.col("event_type"), TOOL_OF_EVENT, "Other")
    path = F.concat(F.lit("/src/d"), (F.col("event_id") % 3).cast("string"), F.lit("/m"), (F.col("event_id") % 11).cast("string"), F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("event_id") % 4 + 1).cast("int")))
    call = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    given = F.when(name == "Bash", F.to_json(F.struct(F.lit("run").alias("command")))).otherwise(F.to_json(F.struct(path.alias("file_path"), F.col("event_type").alias("content"))))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)
    use = F.concat(F.lit('[{"type":"tool_use","id":'), quoted(call), F.lit(',"name":'), quoted(name), F.lit(',"input":'), given, F.lit("}]"))
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":'), quoted(call), F.lit(',"content":'), quoted(F.col("props")), F.lit(',"is_error":'), (F.col("event_type") == "error").cast("string"), F.lit("}]"))
    rows = events.withColumn("_n", n).withColumn("_ts", F.col("ts").cast("timestamp"))
    side = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("assistant").alias("type"), use.alias("content")), F.struct(F.lit(1).alias("i"), F.lit("user").alias("type"), result.alias("content"))))
    rows = rows.withColumn("s", side).withColumn("line_no", F.col("_n") * 2 + F.col("s.i"))
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    ts = F.timestamp_micros(F.unix_micros("_ts") + F.col("s.i") * 2_000_000)
    uuid = lambda line: F.concat(session, F.lit("-"), line.cast("string"))
    return _entries(
        rows.select(
            session.alias("session_id"), F.lit("/data/events").alias("project_path"), "line_no", "s.type", uuid(F.col("line_no")).alias("uuid"), F.when(F.col("line_no") > 0, uuid(F.col("line_no") - 1)).alias("parent_uuid"),
            F.date_format(ts, ISO).alias("ts_text"), ts.alias("ts"), F.when(F.col("s.type") == "assistant", F.lit(MODELS[0])).alias("model"), "s.content", F.lit("array").alias("content_kind"),
        )
    )


class GivenStar(Star):
    """The star over the given tables. A table is computed when first asked for, and read from its Parquet files then."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir, self.kept = sf_dir, {}
        conversations, events = read(spark, sf_dir, "conversations"), read(spark, sf_dir, "events")
        super().__init__(conversation_entries(conversations).unionByName(event_entries(events)), keep=True)

    def table(self, name: str) -> DataFrame:
        if name not in self.kept:
            df = super().table(name)
            self.kept[name] = df if name in self.extra or name in self._seeds or name == "fact_tool_calls" else cut(df, name)
        return self.kept[name]


_stars: dict[tuple[str, str], GivenStar] = {}


def star(spark: SparkSession, sf_dir: str) -> GivenStar:
    """One star for each session of Spark and folder: loaded once, then queried."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stars:
        _stars[key] = GivenStar(spark, sf_dir)
    return _stars[key]

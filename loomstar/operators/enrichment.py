"""Enrichment by functions of the user: messages in batches, with a ledger of answers, sessions one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.functions import columns as C
from loomstar.operators import links

ANSWER = "message_id string, session_key string, intent string, sentiment string, topics array<string>, complexity_score double, confidence_score double"
LEDGER = f"{ANSWER}, enrichment_model string, enriched_at timestamp"
SESSION_MESSAGES = 50


def pending(messages: DataFrame, enriched: DataFrame, message_types: DataFrame) -> DataFrame:
    """Messages with a text that have no enrichment yet, with the measures of their whole text (content_text may be cut) where there are any."""
    measures = [c for c in ("content_length", "word_count") if c in messages.columns]
    rows = messages.where("content_text is not null and length(content_text) > 0").join(enriched.select("message_id"), "message_id", "left_anti")
    return rows.join(message_types, "message_type_key").select("message_id", "session_key", "content_text", "message_type", *measures)


def enrich_messages(rows: DataFrame, function: Callable[[list[dict]], list[dict]], batch_size: int = 10) -> DataFrame:
    """The function's answers: a list of dicts for at most batch_size messages at a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            records, out = frame.to_dict("records"), []
            for at in range(0, len(records), batch_size):
                part = records[at : at + batch_size]
                keys = {r["message_id"]: r["session_key"] for r in part}
                for a in function(part):
                    if not a.get("message_id"):
                        continue
                    out.append((a["message_id"], keys.get(a["message_id"]), a.get("intent", "question"), a.get("sentiment", "neutral"), list(a.get("topics", [])), float(a.get("complexity_score", 0.5)), float(a.get("confidence_score", 0.5))))
            yield pd.DataFrame(out, columns=["message_id", "session_key", "intent", "sentiment", "topics", "complexity_score", "confidence_score"])

    return rows.mapInPandas(run, ANSWER)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All answers under a path: those of every run, each with the model and time; none where there is no folder yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def enrich(path: str, messages: DataFrame, message_types: DataFrame, function: Callable[[list[dict]], list[dict]], model: str, batch_size: int = 10, limit: int | None = None, session_key: str | None = None, per_round: int = 100_000) -> int:
    """Asks for the messages that the ledger has no answer to and writes the answers there; gives how many were asked for.

    limit: so many messages at most, the first by id; session_key: only those of one session. Answers are written in rounds
    of about per_round messages. What a round has written is never asked for again: not by a second table, nor by a run after
    a failure; a lost executor repeats what it had at hand of one round.
    """
    spark = messages.sparkSession
    rows = pending(messages, ledger(spark, path), message_types)
    if session_key is not None:
        rows = rows.where(F.col("session_key") == session_key)
    if limit is not None:
        rows = rows.orderBy("message_id").limit(limit)
    rows = links.cut(rows, "to_be_asked")
    n = rows.count()
    rounds = -(-n // per_round)
    for k in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("message_id"), F.lit(rounds)) == k)
        answers = enrich_messages(part, function, batch_size).withColumns({"enrichment_model": F.lit(model), "enriched_at": F.current_timestamp()})
        answers.write.mode("append").parquet(path)
    return n


def named_key(name: Column, known: list[str], default: str) -> Column:
    return C.dimension_key(F.when(name.isin(known), name).otherwise(F.lit(default)))


def enrichment_facts(answers: DataFrame, model: str, intents: list[str], sentiments: list[str], topics: list[str], at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """fact_message_enrichment and fact_message_topics. Unknown intents and sentiments get the default, unknown topics go.

    Answers that aren't a ledger's are written first, so that the two tables don't ask twice.
    """
    if "enriched_at" in answers.columns:
        name, when = F.col("enrichment_model"), F.col("enriched_at")
    else:
        answers = links.cut(answers, "answers")
        name, when = F.lit(model), F.current_timestamp() if at is None else at
    facts = answers.select(C.dimension_key(F.col("message_id"), F.lit("enrichment")).alias("enrichment_id"), "message_id", "session_key", named_key(F.col("intent"), intents, "question").alias("intent_key"), named_key(F.col("sentiment"), sentiments, "neutral").alias("sentiment_key"), F.col("complexity_score").cast("float").alias("complexity_score"), F.col("confidence_score").cast("float").alias("confidence_score"), name.alias("enrichment_model"), when.alias("enriched_at"))
    rows = answers.select("message_id", F.posexplode("topics").alias("i", "topic")).where(F.col("topic").isin(topics))
    relevance = F.when(F.col("i") < 10, 1.0 - F.col("i") * 0.1).otherwise(0.1)
    return facts, rows.select(C.dimension_key(F.col("message_id"), F.lit("topic"), F.col("i")).alias("message_topic_id"), "message_id", C.dimension_key(F.col("topic")).alias("topic_key"), relevance.cast("float").alias("relevance_score"))


def session_insights(summaries: DataFrame, messages: DataFrame, message_types: DataFrame, function: Callable[[dict], dict], model: str, intents: list[str], done: DataFrame | None = None) -> DataFrame:
    """fact_session_insights: one call for each session that has none, with its measures and first messages by time."""
    nth = F.row_number().over(Window.partitionBy("session_key").orderBy(F.col("timestamp").asc_nulls_last(), "message_id"))
    first = messages.withColumn("_n", nth).where(F.col("_n") <= SESSION_MESSAGES).join(message_types, "message_type_key")
    said = first.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("_n", "message_type", "content_text"))).alias("messages"))
    rows = summaries.join(said, "session_key", "left")
    if done is not None:
        rows = rows.join(done.select("session_key"), "session_key", "left_anti")
    kind = "session_key string, summary_text string, key_decisions string, outcome_status string, task_completed boolean, intent string, complexity_score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                a = function(r)
                out.append((r["session_key"], a.get("summary", ""), a.get("key_decisions", ""), a.get("outcome_status", "unknown"), bool(a.get("task_completed", False)), a.get("primary_intent", "question"), float(a.get("complexity_score", 0.5))))
            yield pd.DataFrame(out, columns=["session_key", "summary_text", "key_decisions", "outcome_status", "task_completed", "intent", "complexity_score"])

    own = rows.select("session_key", "total_messages", "total_tool_calls", "session_duration_seconds", "messages").mapInPandas(run, kind)
    return own.select(C.dimension_key(F.col("session_key"), F.lit("insight")).alias("insight_id"), "session_key", "summary_text", "key_decisions", "outcome_status", "task_completed", named_key(F.col("intent"), intents, "question").alias("primary_intent_key"), F.col("complexity_score").cast("float").alias("complexity_score"), F.lit(model).alias("enrichment_model"), F.current_timestamp().alias("enriched_at"))

"""The queries opN_<name>: each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.llm import decontamination, licences, media_png, neardup, packing, periodic_runs, quality_fm, sharding, toxicity_mil, trie_join, turn_repair, url_graph, warc_revisits
from loomstar.llm.common import fold, shared_folder, table

THRESHOLD = 0.3
QUALITY_METADATA = ("n_chars",)
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SHARDS = 24


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~held, metadata=QUALITY_METADATA)
    scored = quality_fm.score(docs, model, QUALITY_METADATA)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity_mil.fit(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity_mil.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_sentence")


def op6_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media_png.write_images(table(spark, sf_dir, "documents"))
    return media_png.read_images(images, ("doc_id", "n_bytes")).drop("error")


def with_path(docs: DataFrame) -> DataFrame:
    """The documents as files: source/lang/a hundredth of the id, but every tenth in source/lang and every hundredth in source."""
    doc_id = F.col("doc_id")
    at = F.when(doc_id % 100 == 0, F.lit("")).when(doc_id % 10 == 0, F.concat(F.lit("/"), F.col("lang"))).otherwise(F.concat(F.lit("/"), F.col("lang"), F.lit("/d"), (doc_id % 97).cast("string")))
    return docs.select("doc_id", "text", F.concat(F.col("source"), at, F.lit("/"), doc_id.cast("string"), F.lit(".txt")).alias("path"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(with_path(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result follows from the table alone, so each run starts a map of its own."""
    rows = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, f"{shared_folder(spark)}/loomstar-{uuid.uuid4().hex}/slot_map")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve(warc_revisits.captures(table(spark, sf_dir, "pages")))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "canonical_url", "ts", "response_id", "response_ts", "status", F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"), F.md5(flat).alias("headers_md5"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.audits(turn_repair.damaged(conversations), conversations.select("conv_id"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_periods(table(spark, sf_dir, "documents")))
    found = found.withColumn("_best", periodic_runs.strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.join_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_fm, op2_url_graph, op3_packing, op4_decontamination, op5_toxicity_mil, op6_media_png, op7_licences, op8_sharding, op9_warc_revisits, op10_neardup, op11_turn_repair, op12_periodic_runs, op13_trie_join)}

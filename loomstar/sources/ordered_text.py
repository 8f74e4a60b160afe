"""Large text files in order, read in splits: the pieces of a file with exact numbers, and the elements of one JSON array.

A file of any size is read by as many tasks as it has splits. Each task counts its splits' pieces; the sums of the splits before
give every piece its number in the file, so that neither a whole file nor all numbers of one meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.operators.links import cut

#: Splits whose numbers are broadcast at most (some 200 bytes each); beyond, the pieces are shuffled to them.
BROADCAST_SPLITS = 100_000
SPLIT = ["path", "split"]


def with_split_sums(rows: DataFrame, totals: DataFrame, amount: str, name: str) -> DataFrame:
    """rows (path, split) with the sum of an amount over the splits before theirs; totals has a row for each split."""
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(totals.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0))).drop(amount), "split_sums")
    return rows.join(F.broadcast(sums) if sums.count() <= BROADCAST_SPLITS else sums, SPLIT)


def pieces(spark: SparkSession, paths: str | list[str], separator: str | None = None, files: str = "*") -> DataFrame:
    """path, split (its first byte), piece (from 0 in the file) and value: lines, as Python ends them, or what stands between separators."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files)
    raw = (reader.option("lineSep", separator) if separator else reader).text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_at"), "value")
    totals = rows.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    placed = with_split_sums(rows, totals, "_n", "_before")
    return placed.select(*SPLIT, (F.col("_before") + F.col("_at") - F.col("_first")).alias("piece"), "value")


def running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """The sum of an amount over the pieces before each of its file."""
    rows = rows.withColumn("_amount", amount)
    within = Window.partitionBy(*SPLIT).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    summed = with_split_sums(rows, rows.groupBy(*SPLIT).agg(F.sum("_amount").alias("_total")), "_total", "_before")
    return summed.withColumn(name, F.col("_before") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_amount", "_before")


def json_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, nth and element (JSON text): the objects of the JSON array that each file is, in their order."""
    return json_objects(spark, paths, 1).select("path", "nth", F.regexp_replace("text", r"^[\s\[,]*", "").alias("element"))


#: What stands before the first row of a table: the end of the table before, names with values or empty tables, the table's name.
BEFORE_ROWS = r'(?s)^(\s*\]?(?:[^"\[\]]++|"(?:[^"\\]|\\.)*+"|\[\s*+\])*)\[\s*(\{.*)$'


def document_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, head (the document's values before its tables, as JSON), table_name, nth (in the file) and element (JSON text): the rows of the JSON documents that sinks.write_document writes, however they are spaced.

    A document has its tables last, each an array of objects, and single values before them. It is read in splits.
    """
    rows = json_objects(spark, paths, 3)
    first = (F.col("nth") == 0) | F.col("text").rlike(r"^\s*\]")
    rows = rows.withColumn("_before", F.when(first, F.regexp_extract("text", BEFORE_ROWS, 1)))
    rows = cut(rows.withColumn("element", F.when(first, F.regexp_extract("text", BEFORE_ROWS, 2)).otherwise(F.regexp_replace("text", r"^[\s,]*", ""))).drop("text"), "document_rows")
    # a row for each table of each document
    name = F.from_json(F.concat(F.lit("["), F.regexp_extract("_before", r'(?s)("(?:[^"\\]|\\.)*+")\s*:\s*$', 1), F.lit("]")), "array<string>")[0]
    until = F.coalesce(F.lead("nth").over(Window.partitionBy("path").orderBy("nth")), F.lit(2**62))
    head = F.when(F.col("nth") == 0, F.regexp_replace("_before", r'(?s),?\s*"tables"\s*:\s*\{.*$', "}"))
    heads = F.max(head).over(Window.partitionBy("path"))
    tables = rows.where("_before is not null").select("path", F.col("nth").alias("_from"), until.alias("_until"), name.alias("table_name"), heads.alias("head"))
    within = (F.col("r.path") == F.col("t.path")) & (F.col("nth") >= F.col("_from")) & (F.col("nth") < F.col("_until"))
    return rows.alias("r").join(F.broadcast(tables).alias("t"), within).select("r.path", "head", "table_name", "nth", "element")


def json_objects(spark: SparkSession, paths: str | list[str], depth: int) -> DataFrame:
    """path, nth and text: the objects that stand so deep in the JSON value of each file, in their order, each with all that stands between it and the one before.

    The files are read in pieces between closing braces. A piece doesn't know whether it begins in a string, so it counts its
    brackets for both cases; sums of quotes before it tell the case, sums of brackets the depth, and a brace that leads
    back to that depth ends an object. Only the pieces of one object meet.
    """
    parts = cut(pieces(spark, paths, "}"), "json_pieces")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no escape goes over a brace
    count = lambda text, marks: F.length(text) - F.length(F.translate(text, marks, ""))
    outside = lambda text: F.regexp_replace(text, r'(?s)"[^"]*(?:"|$)', "")
    deeper = lambda text: (count(text, "{[") - count(text, "}]")).cast("long")
    light = parts.select(*SPLIT, "piece", count(bare, '"').cast("long").alias("quotes"), deeper(outside(bare)).alias("_plain"), deeper(outside(F.concat(F.lit('"'), bare))).alias("_quoted"))
    light = running(cut(light, "json_counts"), F.col("quotes"), "_quotes")
    ends_inside = (F.col("_quotes") + F.col("quotes")) % 2 == 1
    step = F.when(F.col("_quotes") % 2 == 1, F.col("_quoted")).otherwise(F.col("_plain")) - F.when(ends_inside, 0).otherwise(1)
    light = running(cut(light.select(*SPLIT, "piece", ends_inside.alias("_inside"), step.alias("_step")), "json_steps"), F.col("_step"), "_depth")
    ends = (~F.col("_inside") & (F.col("_depth") + F.col("_step") == depth)).cast("long")
    light = running(cut(light.select(*SPLIT, "piece", ends.alias("_ends")), "json_ends"), F.col("_ends"), "nth")
    own = parts.join(light.select("path", "piece", "nth", "_ends"), ["path", "piece"])
    whole = own.groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("_pieces"), F.max("_ends").alias("_ends")).where("_ends = 1")
    text = F.concat(F.array_join(F.transform("_pieces", lambda x: x["value"]), "}"), F.lit("}"))
    return whole.select("path", "nth", text.alias("text"))

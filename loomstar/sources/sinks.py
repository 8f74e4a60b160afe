"""Writers: Parquet, catalog tables and JSON with a manifest."""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import reduce
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Relationships that the manifest declares.
RELATIONSHIPS = [
    ("fact_messages", "session_key", "dim_session", "session_key"),
    ("fact_messages", "model_key", "dim_model", "model_key"),
    ("fact_messages", "date_key", "dim_date", "date_key"),
    ("fact_messages", "time_key", "dim_time", "time_key"),
    ("fact_tool_calls", "tool_key", "dim_tool", "tool_key"),
    ("fact_tool_calls", "session_key", "dim_session", "session_key"),
    ("fact_file_operations", "file_key", "dim_file", "file_key"),
    ("fact_code_blocks", "language_key", "dim_programming_language", "language_key"),
    ("dim_session", "project_key", "dim_project", "project_key"),
]


def resolve_format(name: str, schema: str | None = None) -> tuple[str, str]:
    """(schema, format): a -star suffix asks for the star schema, an explicit schema wins."""
    base = name.removesuffix("-star")
    return schema or ("star" if name.endswith("-star") else "simple"), base


def write_parquet(tables: dict[str, DataFrame], folder: str, partitions: dict[str, list[str]] | None = None) -> None:
    """One folder of Parquet files for each table; a second run replaces the first."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{folder}/{name}")


def write_counted(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", place: Callable[[str], str] = str) -> dict[str, int]:
    """Writes each table to a folder of its name (or where place says) and gives its rows, counted as they are written."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(kind).save(f"{folder}/{place(name)}")
        counts[name] = seen.get["n"]
    return counts


def append_sessions(df: DataFrame, folder: str, key: str = "session_key", buckets: int = 64) -> None:
    """Adds a table's rows by session: earlier rows of the same sessions are replaced, a second run changes nothing.

    Sessions are dealt into buckets; only the buckets of the sessions at hand are written again.
    """
    from loomstar.operators.links import cut

    spark = df.sparkSession
    new = cut(df.withColumn("session_bucket", F.pmod(F.hash(key), F.lit(buckets))), "appended")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.parquet(folder).join(new.select("session_bucket").distinct(), "session_bucket", "left_semi")
        new = cut(new.unionByName(old.join(new.select(key).distinct(), key, "left_anti")), "merged")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_bucket").parquet(folder)


def save_tables(tables: dict[str, DataFrame], database: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def write_json(spark: SparkSession, tables: dict[str, DataFrame], folder: str, schema: str) -> dict[str, int]:
    """JSON Lines of each table, and a manifest with row counts, schema and declared relationships; gives the counts."""
    counts = write_counted(tables, folder, "json", lambda n: f"{'dimensions' if n.startswith('dim_') else 'facts' if n.startswith('fact_') else 'tables'}/{n}")
    known = [r for r in RELATIONSHIPS if r[0] in tables and r[2] in tables]
    meta = {"version": "1.0", "schema_type": schema, "row_counts": counts, "relationships": [dict(zip(("from_table", "from_column", "to_table", "to_column"), r, strict=True)) for r in known]}
    out = spark.createDataFrame([(json.dumps(meta),)], "value string").withColumn("exported_at", F.current_timestamp())
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return counts


def write_lines(spark: SparkSession, lines: DataFrame, order: list[str], text: str, path: str) -> None:
    """One text file of all lines in their order, under the name given; no task sorts or writes more than a range of them, and none goes through the driver.

    Only where the shared folder's file system can neither be written at places nor join files, one task writes them all.
    """
    from loomstar.operators.links import shared_folder

    folder = f"{shared_folder(spark)}/loomstar-{uuid.uuid4().hex}"
    lines.orderBy(*order).select(text).write.text(f"{folder}/parts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.Path(f"{folder}/lines"), hadoop.Path(path)
    here, there = source.getFileSystem(conf), target.getFileSystem(conf)
    if not join_parts(spark, here, f"{folder}/parts", source):
        lines.repartition(1).sortWithinPartitions(*order).select(text).write.text(f"{folder}/one")
        source = next(p for p, _ in parts_of(spark, here, f"{folder}/one"))
    there.mkdirs(target.getParent())
    there.delete(target, False)
    same = here.getUri().equals(there.getUri())  # then the file is only given its name
    if not (there.rename(source, target) if same else hadoop.FileUtil.copy(here, source, there, target, True, True, conf)):
        raise OSError(f"{path} could not be written")


def parts_of(spark: SparkSession, system: Any, folder: str) -> list[tuple[Any, int]]:
    """Path and bytes of the files that tasks wrote to a folder, in their order."""
    found = system.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    return sorted(((f.getPath(), f.getLen()) for f in found if f.getPath().getName().startswith("part-")), key=lambda f: f[0].getName())


def join_parts(spark: SparkSession, system: Any, folder: str, path: Any) -> bool:
    """One file of a folder's parts, in their order: copied to their places by as many tasks, or joined by the file system; false if it can do neither."""
    parts = [(p, n) for p, n in parts_of(spark, system, folder) if n]
    if system.getUri().getScheme() != "file":
        return concatenated(spark, system, [p for p, _ in parts], path)
    ends = list(accumulate((n for _, n in parts), initial=0))
    target = path.toUri().getPath()
    with open(target, "wb") as f:
        f.truncate(ends[-1])

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, at in zip(frame["part"], frame["at"], strict=True):
                with open(part, "rb") as here, open(target, "r+b") as there:
                    there.seek(at)
                    shutil.copyfileobj(here, there, 2**20)
                    yield pd.DataFrame({"n": [there.tell() - at]})

    rows = spark.createDataFrame([(p.toUri().getPath(), at) for (p, _), at in zip(parts, ends, strict=False)], "part string, at long")
    copied = rows.repartition(max(1, len(parts))).mapInPandas(copy, "n long").agg(F.sum("n")).first()[0] or 0
    if copied != ends[-1]:
        raise OSError(f"{copied} of {ends[-1]} bytes were written")
    return True


def concatenated(spark: SparkSession, system: Any, parts: list[Any], path: Any) -> bool:
    """The files, joined in a new one by the file system, without a copy in HDFS; false if it doesn't join files."""
    given = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(parts))
    for k, p in enumerate(parts):
        given[k] = p
    system.create(path).close()
    try:
        if parts:
            system.concat(path, given)
    except UnsupportedOperationException:
        return False
    return True


def write_json_array(spark: SparkSession, rows: DataFrame, order: list[str], text: str, path: str) -> None:
    """One file with one JSON array of the rows' JSON texts, in their order."""
    from loomstar.operators.numbering import global_row_numbers

    placed = global_row_numbers(rows.select(*order, F.col(text).alias("_text")), order, "_place")
    comma = F.when(F.col("_place") > 0, ",").otherwise("")
    ends = spark.createDataFrame([(-1, "["), (2**62, "]")], "_place long, _text string")
    write_lines(spark, placed.select("_place", F.concat(comma, "_text").alias("_text")).unionByName(ends), ["_place"], "_text", path)


def write_document(spark: SparkSession, tables: dict[str, DataFrame], path: str, schema: str = "simple") -> None:
    """One JSON document of all tables: version, schema_type, exported_at and tables, each an array of its rows with their nulls."""
    from loomstar.operators.links import cut

    first = {"version": "1.0", "schema_type": schema, "exported_at": datetime.now(UTC).isoformat()}
    frame, parts = [(-1, 0, 0, json.dumps(first)[:-1] + ', "tables": {'), (len(tables), 0, 0, "}}")], []
    for k, (name, df) in enumerate(tables.items()):
        frame += [(k, 0, 0, f"{',' if k else ''}{json.dumps(name)}: ["), (k, 2, 0, "]")]
        rows = cut(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "document_rows")
        least = rows.agg(F.min("_row")).first()[0]
        parts.append(rows.select(F.lit(k).alias("_table"), F.lit(1).alias("_kind"), "_row", F.concat(F.when(F.col("_row") == least, "").otherwise(","), "_text").alias("_text")))
    lines = reduce(DataFrame.unionByName, parts, spark.createDataFrame(frame, "_table int, _kind int, _row long, _text string"))
    write_lines(spark, lines, ["_table", "_kind", "_row"], "_text", path)


def write_search_index(spark: SparkSession, documents: DataFrame, folder: str, version: int = 1) -> int:
    """What a search reads: the documents (conversation.search_documents) as JSON Lines, and a line with version and count beside them."""
    n = write_counted({"documents": documents}, folder, "json")["documents"]
    spark.createDataFrame([(version, n)], "version int, documents long").coalesce(1).write.mode("overwrite").json(f"{folder}/version")
    return n


def statistics(spark: SparkSession, folder: str, counts: dict[str, int], seconds: float) -> dict:
    """Sessions, rows of the main tables, size on disk and sessions a second of an archive that took so long."""
    star = "fact_messages" in counts
    main = ("fact_messages", "fact_tool_calls", "fact_content_blocks", "fact_session_summary") if star else ("messages", "tool_calls", "sessions")
    sessions = counts["dim_session" if star else "sessions"]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return {"sessions": sessions, "rows": sum(counts[t] for t in main), "size_mb": round(size / 2**20, 2), "seconds": round(seconds, 1), "rate": round(sessions / max(seconds, 1e-9), 2)}


def write_failed(spark: SparkSession, entries: DataFrame, folder: str, told: int = 1000) -> dict:
    """Writes session, project, line and reason of all sessions set aside as failed_sessions below the folder; their count, the table's path, the first ids, and how many there are of each reason."""
    from loomstar.sources import transcripts

    path = f"{folder}/failed_sessions"
    transcripts.session_errors(entries).write.mode("overwrite").parquet(path)
    failed = spark.read.schema("session_id string, project_path string, line_no int, error string").parquet(path)
    first = [r["session_id"] for r in failed.orderBy("session_id").limit(told).collect()]
    reasons = {r["error"]: r["count"] for r in failed.groupBy("error").count().collect()}  # reasons are few
    return {"failed_sessions": first, "failed_count": sum(reasons.values()), "failed_path": path, "failed_reasons": reasons}


def archive(spark: SparkSession, source: str, folder: str, schema: str = "star", include_agents: bool = False, thinking: bool = True, truncate: int = 2000) -> dict:
    """Reads all transcripts below a folder, writes the tables, and tells what was done; broken sessions are told, not loaded."""
    from loomstar.operators.links import cut
    from loomstar.operators.simple import simple_tables
    from loomstar.operators.star import Star
    from loomstar.sources import transcripts

    entries = cut(transcripts.read_entries(spark, source), "entries")  # the files are parsed once
    if not include_agents:
        entries = entries.where(~F.col("session_id").startswith("agent-"))
    tables = Star(entries, truncate, thinking, keep=True).tables() if schema == "star" else simple_tables(entries, truncate, include_thinking=thinking)
    return {"schema": schema, "tables": write_counted(tables, folder), **write_failed(spark, entries, folder)}

"""python -m loomstar all|import|schema|query: batch export, account export, structure of JSON, queries of the catalogue."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.functions.columns import matches_project
from loomstar.operators import inspection, links, simple
from loomstar.operators.star import Star
from loomstar.plans import catalogue
from loomstar.sources import sinks, transcripts


def tell(rows: DataFrame) -> None:
    """Every row as a line of JSON; partitions come one by one."""
    for r in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(r["line"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstar")
    sub = top.add_subparsers(dest="command", required=True)
    every = sub.add_parser("all", help="transcripts below a folder to tables")
    every.add_argument("source")
    every.add_argument("output")
    every.add_argument("--format", default="parquet-star", help="parquet, parquet-star, json or json-star")
    every.add_argument("--schema", choices=["simple", "star"])
    every.add_argument("--project", help="only projects whose name or folder holds this")
    every.add_argument("--include-agents", action="store_true")
    every.add_argument("--include-thinking", action="store_true")
    every.add_argument("--dry-run", action="store_true", help="list the sessions, write nothing")
    account = sub.add_parser("import", help="an account's export to the simple schema")
    account.add_argument("source")
    account.add_argument("output", nargs="?")
    account.add_argument("--list", action="store_true", help="list the conversations, write nothing")
    account.add_argument("-c", "--conversation", action="append")
    account.add_argument("--no-thinking", action="store_true")
    schema = sub.add_parser("schema", help="structure of a transcript or of a folder of JSON documents")
    schema.add_argument("path")
    schema.add_argument("--samples", type=int, default=5)
    ask = sub.add_parser("query", help="a query of the catalogue over transcripts")
    ask.add_argument("source")
    ask.add_argument("name", choices=sorted(catalogue.CATALOGUE))
    return top


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("loomstar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "import" and (given.list or not given.output):
        tell(transcripts.listed_conversations(transcripts.account_conversations(spark, f"{given.source}/conversations.json")))
    elif given.command == "import":
        tables = simple.from_account_export(spark, given.source, given.conversation, not given.no_thinking)
        print(json.dumps(sinks.write_counted(tables, given.output)))
    elif given.command == "schema":
        lines = given.path.endswith(".jsonl")
        tell((inspection.inspect_lines(spark, given.path, given.samples) if lines else inspection.inspect_folder(spark, given.path)).orderBy("path", "kind"))
    elif given.command == "query":
        tell(catalogue.run(spark, given.name, Star(transcripts.read_entries(spark, given.source), keep=True).table))
    else:
        entries = transcripts.read_entries(spark, given.source).where(matches_project(F.element_at(F.split("project_path", "/"), -1), given.project))
        if not given.include_agents:
            entries = entries.where(~F.col("session_id").startswith("agent-"))
        kind, form = sinks.resolve_format(given.format, given.schema)
        if given.dry_run:
            tell(transcripts.messages_only(entries).groupBy("project_path", "session_id").count().orderBy("project_path", "session_id"))
            return
        began = time.perf_counter()
        entries = links.cut(entries, "entries")  # the files are parsed once
        tables = Star(entries, thinking=given.include_thinking, keep=True).tables() if kind == "star" else simple.simple_tables(entries, include_thinking=given.include_thinking)
        counts = sinks.write_json(spark, tables, given.output, kind) if form == "json" else sinks.write_counted(tables, given.output)
        done = sinks.statistics(spark, given.output, counts, time.perf_counter() - began)
        print(json.dumps({"schema": kind, "tables": sorted(tables), **done, **sinks.write_failed(spark, entries, given.output)}))


if __name__ == "__main__":
    main()

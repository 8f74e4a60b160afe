"""Structure of JSON without its values: types, string formats, presence, merged over many documents."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.functions.columns import STRING_FORMATS


def leaves(value, path: str = "$") -> Iterator[tuple[str, str, str | None]]:
    """(path, type, text of a string) of a JSON value and all within it; elements of arrays share one path."""
    if isinstance(value, dict):
        yield path, "object", None
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        yield path, "array", None
        for v in value:
            yield from leaves(v, f"{path}[]")
    elif isinstance(value, str):
        yield path, "string", value
    else:
        yield path, "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number", None


SUMMARY = "group string, path string, kind string, n long, documents long, length_min int, length_max int, formats map<string, long>, enum_values array<string>, many boolean"
FORMATS = [(name, re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)) for name, pattern in STRING_FORMATS]
#: Summaries that a task holds before it passes them on.
HELD = 50_000


def format_of(text: str) -> str | None:
    return next((name for name, pattern in FORMATS if pattern.search(text)), None)


class Summary:
    """What is known of the values of one path and kind: it grows by values, and summaries merge."""

    __slots__ = ("n", "documents", "last", "shortest", "longest", "formats", "values")

    def __init__(self) -> None:
        self.n, self.documents, self.last, self.shortest, self.longest = 0, 0, -1, None, None
        self.formats: Counter[str] = Counter()
        self.values: set[str] | None = set()  # of enum-like strings; none when there are too many

    def add(self, document: int, text: str | None, enum_limit: int) -> None:
        self.n += 1
        self.documents, self.last = self.documents + (document != self.last), document
        if text is None:
            return
        self.shortest = len(text) if self.shortest is None else min(self.shortest, len(text))
        self.longest = max(self.longest or 0, len(text))
        if kind := format_of(text):
            self.formats[kind] += 1
            if kind == "enum_like" and self.values is not None:
                self.values.add(text)
                if len(self.values) > enum_limit:
                    self.values = None

    def row(self) -> tuple:
        return self.n, self.documents, self.shortest, self.longest, dict(self.formats), sorted(self.values or ()), self.values is None


def summaries(documents: DataFrame, column: str, enum_limit: int, by: str | None = None) -> DataFrame:
    """A row for each group, path and kind of each task: its documents, merged as they are read. Broken documents have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Summary] = defaultdict(Summary)
        names = ["group", "path", "kind", "n", "documents", "length_min", "length_max", "formats", "enum_values", "many"]
        told = lambda: pd.DataFrame([(*key, *s.row()) for key, s in held.items()], columns=names)
        number = 0
        for frame in frames:
            for group, text in zip(frame["group"], frame["_text"], strict=True):
                number += 1
                try:
                    found = list(leaves(json.loads(text)))
                except (TypeError, ValueError):
                    continue
                for path, kind, value in found:
                    held[group, path, kind].add(number, value, enum_limit)
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    own = documents.select((F.col(by) if by else F.lit("")).cast("string").alias("group"), F.col(column).cast("string").alias("_text"))
    return own.mapInPandas(run, SUMMARY)


def profile(documents: DataFrame, column: str, enum_limit: int = 10, by: str | None = None) -> DataFrame:
    """path, kind, n, documents, presence, length_min, length_max, formats (map), enum_values (at most enum_limit, else null).

    Each task merges its documents to summaries, which are then merged: one pass over the documents, and a row for each
    path and kind of each task. by: a column; each of its values gets a profile of its own, and the result that column.
    """
    keys = ["group", "path", "kind"]
    totals = documents.groupBy((F.col(by) if by else F.lit("")).cast("string").alias("group")).agg(F.count(F.lit(1)).alias("_total"))
    added = F.aggregate(F.flatten(F.collect_list(F.map_entries("formats"))), F.create_map().cast("map<string,bigint>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], F.coalesce(F.try_element_at(m, e["key"]), F.lit(0)) + e["value"])))
    sums = [F.sum(c).alias(c) for c in ("n", "documents")]
    rows = summaries(documents, column, enum_limit, by).groupBy(*keys).agg(*sums, F.min("length_min").alias("length_min"), F.max("length_max").alias("length_max"), added.alias("_formats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("enum_values")))).alias("_values"), F.max("many").alias("_many"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("_formats")))
    few = ~F.col("_many") & F.size("_values").between(1, enum_limit)
    rows = rows.withColumn("formats", F.when(F.size("_formats") > 0, ordered)).withColumn("enum_values", F.when(few, F.col("_values"))).drop("_formats", "_values", "_many")
    out = rows.join(totals, "group").withColumn("presence", F.col("documents") / F.col("_total")).drop("_total")
    return out.withColumnRenamed("group", by) if by else out.drop("group")


def inspect_lines(spark: SparkSession, path: str, samples: int = 5) -> DataFrame:
    """The profile of the first valid lines of a transcript, twice the number of samples."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull()).limit(2 * samples)
    return profile(lines, "value")


def inspect_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles of all JSON documents of a folder, by file."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True)
    return profile(raw.select(F.col("_metadata.file_name").alias("file"), "value"), "value", by="file")

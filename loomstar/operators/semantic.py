"""The semantic model of a set of tables, inferred from names, and the query builder that joins by it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

MODEL = "table_name string, table_type string, table_display_name string, column_name string, column_display_name string, column_type string, data_type string, default_aggregation string, related_table string, related_column string, is_visible boolean, is_filterable boolean, sort_order int"
META = "meta_semantic_model"
MEASURE_ENDS = ("_count", "_length", "_score", "_seconds", "_size", "_chars", "_tokens", "_depth")
#: The first mark found in a measure's name gives its aggregation.
AGGREGATIONS = [("_count", "sum"), ("total_", "sum"), ("_length", "sum"), ("_size", "sum"), ("_chars", "sum"), ("_tokens", "sum"), ("_seconds", "avg"), ("_time", "avg"), ("_score", "avg"), ("_depth", "max")]
PREFIXES = {"dim_": "dimension", "fact_": "fact", "stg_": "staging", "semantic_": "semantic"}
#: Relationships that names don't tell.
DECLARED = [("fact_code_blocks", "language_key", "dim_programming_language", "language_key"), ("fact_tool_chain_steps", "prev_tool_key", "dim_tool", "tool_key"), ("fact_session_insights", "primary_intent_key", "dim_intent", "intent_key")]
KINDS = {"string": "varchar", "int": "integer", "bigint": "integer", "smallint": "integer", "float": "float", "double": "float", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "date", "boolean": "boolean"}


def table_type(name: str) -> str:
    return next((kind for prefix, kind in PREFIXES.items() if name.startswith(prefix)), "other")


def data_type(kind: str, column: str) -> str:
    if column.endswith("_json"):
        return "json"
    return "float" if kind.startswith("decimal") else KINDS.get(kind, "varchar")


def column_type(column: str, kind: str, of_table: str) -> str:
    if column.endswith(("_key", "_id")):
        return "key"
    measured = of_table in ("fact", "semantic")
    if measured and kind in ("integer", "float") and (column.endswith(MEASURE_ENDS) or column.startswith(("total_", "estimated_"))):
        return "measure"
    return "measure" if measured and kind == "boolean" and column.startswith(("is_", "has_")) else "attribute"


def aggregation(column: str) -> str:
    marked = (how for mark, how in AGGREGATIONS if (column.startswith(mark) if mark == "total_" else mark in column))
    return next(marked, "sum")


def related(column: str, tables: dict[str, DataFrame]) -> tuple[str | None, str | None]:
    name = "dim_" + column.rsplit("_", 1)[0]
    return (name, column) if name in tables else (None, None)


def display(name: str, prefixes: tuple[str, ...] = ()) -> str:
    for p in prefixes:
        if name.startswith(p):
            name = name[len(p) :]
            break
    return name.replace("_", " ").title()


def semantic_rows(tables: dict[str, DataFrame], declared: bool = False) -> list[tuple]:
    rows = []
    for table in sorted(tables):
        kind = table_type(table)
        for order, (column, raw) in enumerate(tables[table].dtypes):
            data = data_type(raw, column)
            what = column_type(column, data, kind)
            to = related(column, tables) if kind in ("fact", "staging") and what == "key" else (None, None)
            if declared and to == (None, None):
                to = next(((d, c) for t, f, d, c in DECLARED if (t, f) == (table, column)), (None, None))
            rows.append((table, kind, display(table, ("dim_", "fact_", "stg_")), column, display(column), what, data, aggregation(column) if what == "measure" else None, *to, what != "key" or kind == "dimension", what in ("key", "attribute"), order))
    return rows


def semantic_model(spark: SparkSession, tables: dict[str, DataFrame], declared: bool = False) -> DataFrame:
    """A row for each column of each table."""
    return spark.createDataFrame(semantic_rows(tables, declared), MODEL)


def tables_of(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of a database, without the stored model, by name."""
    return {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary and t.name != META}


def described(spark: SparkSession, database: str) -> DataFrame:
    """table_name, column_name, data_type and place of each column that the catalogue tells of a database."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables(database) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, place int")


def attach(spark: SparkSession, database: str, files: dict[str, str], kind: str = "parquet") -> None:
    """Makes tables of a database from files where they lie, without a copy: name and path."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in files.items():
        location = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE `{database}`.`{name}` USING {kind} LOCATION '{location}'")


def save_model(spark: SparkSession, database: str, declared: bool = False) -> None:
    """Stores the model of a database's tables as a table beside them; a second run replaces the first."""
    rows = semantic_model(spark, tables_of(spark, database), declared)
    rows.coalesce(1).write.mode("overwrite").saveAsTable(f"{database}.{META}")


def stored_model(spark: SparkSession, database: str) -> DataFrame | None:
    """The stored model; none if there is no such table, or one with other columns."""
    if not spark.catalog.tableExists(f"{database}.{META}"):
        return None
    model, names = spark.table(f"{database}.{META}"), [c.split()[0] for c in MODEL.split(", ")]
    return model.select(*names) if set(names) <= set(model.columns) else None


def aggregate(column: Column, how: str, kind: str) -> Column:
    """A measure's default aggregation; booleans are counted where true."""
    return F.count_if(column) if kind == "boolean" else {"sum": F.sum, "avg": F.avg, "max": F.max}[how](column)


@dataclass
class QueryBuilder:
    """Columns, filters, sorts and pages over a base table; joins only the dimensions that they need.

    A filter compares text with text and holds for selected columns alone. A dimension without a relationship to the
    base table is left out with its columns.
    """

    tables: dict[str, DataFrame]
    base: str | None = None
    declared: bool = False
    page_size: int = 100
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    filters: dict[str, list] = field(default_factory=dict)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    page: int = 0
    model: list[tuple] | None = None

    @classmethod
    def of_database(cls, spark: SparkSession, database: str, declared: bool = False) -> QueryBuilder:
        """A builder over the tables of a database, joined by the model stored there, or else by one made from their names."""
        model = stored_model(spark, database)
        rows = None if model is None else [tuple(r) for r in model.orderBy("table_name", "sort_order").collect()]  # a row for each column
        return cls(tables_of(spark, database), declared=declared, model=rows)

    def set_base_table(self, name: str) -> QueryBuilder:
        self.base, self.columns, self.filters, self.sorts, self.page = name, [], {}, [], 0
        return self

    def add_column(self, table: str, column: str) -> QueryBuilder:
        taken, alias, n = {a for _, _, a in self.columns}, column, 1
        while alias in taken:
            alias, n = f"{column}_{n}", n + 1
        self.columns.append((table, column, alias))
        return self

    def remove_column(self, alias: str) -> QueryBuilder:
        self.columns = [c for c in self.columns if c[2] != alias]
        self.filters.pop(alias, None)
        self.sorts = [s for s in self.sorts if s[0] != alias]
        return self

    def set_filter(self, alias: str, values: list) -> QueryBuilder:
        self.filters[alias], self.page = values, 0
        return self

    def clear_filters(self) -> QueryBuilder:
        self.filters, self.page = {}, 0
        return self

    def toggle_sort(self, alias: str) -> QueryBuilder:
        """Ascending, descending, none; one column at a time."""
        now = dict(self.sorts).get(alias)
        self.sorts = [] if now == "desc" else [(alias, "desc" if now == "asc" else "asc")]
        return self

    def set_page(self, page: int, total: int | None = None) -> QueryBuilder:
        last = page if total is None else max(0, -(-total // self.page_size) - 1)
        self.page = min(max(0, page), last)
        return self

    def relationships(self) -> dict[str, tuple[str, str]]:
        """Dimension: (column of the base table, column of the dimension)."""
        found: dict[str, tuple[str, str]] = {}
        for row in self.model if self.model is not None else semantic_rows({**self.tables}, self.declared):
            if row[0] == self.base and row[8] in self.tables and row[8] not in found:
                found[row[8]] = (row[3], row[9])
        return found

    def _filtered(self) -> tuple[DataFrame, dict[str, Column]]:
        rows = self.tables[self.base].alias("f")
        known, by = self.relationships(), {self.base: "f"}
        for table in dict.fromkeys(t for t, _, _ in self.columns if t != self.base and t in known):
            by[table] = f"d{len(by)}"
            own, other = known[table]
            rows = rows.join(self.tables[table].alias(by[table]), F.col(f"f.{own}") == F.col(f"{by[table]}.{other}"), "left")
        shown = {a: F.col(f"{by[t]}.{c}") for t, c, a in self.columns if t in by}
        for alias, values in self.filters.items():
            if values and alias in shown:
                rows = rows.where(shown[alias].cast("string").isin([str(v) for v in values]))
        return rows, shown

    def rows(self) -> DataFrame:
        """All rows, sorted, with nulls last."""
        rows, shown = self._filtered()
        order = [shown[a].asc_nulls_last() if d == "asc" else shown[a].desc_nulls_last() for a, d in self.sorts if a in shown]
        rows = rows.orderBy(*order) if order else rows
        return rows.select(*[c.alias(a) for a, c in shown.items()])

    def run(self) -> DataFrame:
        """The current page."""
        return self.rows().offset(self.page * self.page_size).limit(self.page_size)

    def page_after(self, last: Row | None = None, equal: int = 0, counted: Observation | None = None) -> DataFrame:
        """The page behind a row, found by the row's values: nothing is sorted but a page in each task, however deep it lies.

        last: the last row of the page before (none for the first page), equal: how many rows equal to it have been shown;
        counted: gets cnt, the number of rows of all pages, as this page is computed. Rows come in the order of the sorts,
        then of the other columns.
        """
        rows, shown = self._filtered()
        keys = [(a, d) for a, d in self.sorts if a in shown]
        keys += [(a, "asc") for a in shown if a not in dict(keys)]
        rows = rows.select(*[c.alias(a) for a, c in shown.items()])
        if counted is not None:
            rows = rows.observe(counted, F.count(F.lit(1)).alias("cnt"))
        if last is not None:
            kinds = {f.name: f.dataType for f in rows.schema}
            behind, same = F.lit(False), F.lit(True)
            for a, d in keys:
                value = F.lit(last[a]).cast(kinds[a])
                further = F.col(a) > value if d == "asc" else F.col(a) < value
                nulls_last = F.col(a).isNull() & value.isNotNull()
                behind = behind | (same & F.coalesce(further | nulls_last, nulls_last))
                same = same & F.col(a).eqNullSafe(value)
            rows = rows.where(behind | same)
        order = [F.col(a).asc_nulls_last() if d == "asc" else F.col(a).desc_nulls_last() for a, d in keys]
        return rows.orderBy(*order).offset(equal if last is not None else 0).limit(self.page_size)

    def walk(self) -> Iterator[list[Row]]:
        """Page after page, as lists of rows, each found from the one before."""
        last, equal = None, 0
        while rows := self.page_after(last, equal).collect():  # page_size rows at most
            yield rows
            equal = rows.count(rows[-1]) + (equal if rows[-1] == last else 0)
            last = rows[-1]

    def count(self) -> DataFrame:
        return self._filtered()[0].agg(F.count(F.lit(1)).alias("cnt"))

    def distinct_values(self, table: str, column: str, search: str = "", limit: int = 100) -> DataFrame:
        """The first values of a column that contain a text, ignoring case."""
        rows = self.tables[table].select(F.col(column).alias("val")).where("val is not null")
        if search:
            rows = rows.where(F.contains(F.lower(F.col("val").cast("string")), F.lit(search.lower())))
        return rows.distinct().orderBy("val").limit(limit)

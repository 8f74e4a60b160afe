"""As-of links, depths in a tree and closures, as joins and windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, as spark.checkpoint.dir names it; only in local mode, where none is named, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomstar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts a growing lineage: df as Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/loomstar-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_before(rows: DataFrame, keys: list[str], order: list[str], is_source: str, value: str, name: str) -> DataFrame:
    """Each row with the value of the latest earlier row of its keys that is a source (null without one).

    One window over the keys does the as-of join: both sides are the same rows, so nothing is multiplied.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(F.col(is_source), F.col(value)), ignorenulls=True).over(before))


def depths(nodes: DataFrame, group: str, order: str, node: str, parent: str) -> DataFrame:
    """group, order and depth of each row; a parent counts if it occurs earlier in the group, its latest row then.

    Rows that follow their parents directly form runs, whose places are counted by a window. Only the heads of runs are
    then linked, by pointer doubling: after k rounds each knows the run 2**k steps up, so a chain of n runs takes
    log2(n) joins, a plain conversation none. It ends, as each step goes up to an earlier row.
    """
    base = nodes.select(group, F.col(order).alias("_o"), F.col(node).alias("_n"), F.col(parent).alias("_p"))
    both = base.select(group, F.col("_n").alias("_key"), "_o", F.lit(True).alias("_is"), F.col("_o").alias("_at")).unionByName(base.select(group, F.col("_p").alias("_key"), "_o", F.lit(False).alias("_is"), F.lit(None).cast(dict(base.dtypes)["_o"]).alias("_at")))
    linked = latest_before(both, [group, "_key"], ["_o", "_is"], "_is", "_at", "_up").where("not _is")
    by = Window.partitionBy(group).orderBy("_o")
    rows = linked.select(group, "_o", F.when(F.col("_key").isNotNull(), F.col("_up")).alias("_up"))
    rows = rows.withColumn("_head", F.coalesce(F.col("_up") != F.lag("_o").over(by), F.lit(True))).withColumn("_nth", F.row_number().over(by))
    started = F.last(F.when(F.col("_head"), F.struct(F.col("_o").alias("run"), "_nth")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = cut(rows.withColumn("_run", started).select(group, "_o", "_up", "_head", F.col("_run.run").alias("_run"), (F.col("_nth") - F.col("_run._nth")).alias("_place")), "runs")
    heads = rows.where("_head")
    if heads.where("_up is not null").limit(1).count() == 0:  # each run starts at a root
        return rows.select(group, F.col("_o").alias(order), F.col("_place").cast("int").alias("conversation_depth"))
    # these tables compress so well that by their files' size Spark would broadcast millions of rows through the driver
    above = rows.select(group, F.col("_o").alias("_up"), F.col("_run").alias("_next"), (F.col("_place") + 1).alias("_d"))
    heads = heads.select(group, "_run", "_up").join(above.hint("merge"), [group, "_up"], "left")
    state = cut(heads.select(group, "_run", F.col("_next").alias("_up"), F.coalesce("_d", F.lit(0)).alias("_d")), "depths")
    while state.where("_up is not null").limit(1).count():
        above = state.select(group, F.col("_run").alias("_up"), F.col("_up").alias("_next"), F.col("_d").alias("_more"))
        state = cut(state.join(above.hint("merge"), [group, "_up"], "left").select(group, "_run", F.col("_next").alias("_up"), (F.col("_d") + F.coalesce("_more", F.lit(0))).alias("_d")), "depths")
    return rows.join(state.select(group, "_run", "_d").hint("merge"), [group, "_run"]).select(group, F.col("_o").alias(order), (F.col("_d") + F.col("_place")).cast("int").alias("conversation_depth"))


def closure(edges: DataFrame, roots: DataFrame, recursive: bool = True, rounds: int | None = None) -> DataFrame:
    """child, root of the rows of edges (child, parent) that hang below the roots (id), each with the nearest of them; only direct ones if not recursive.

    A child knows the roots that it has reached, or who stands 2**k steps above it; a round doubles the steps, so a
    chain of n takes about log2(n) joins. Who has no root above drops out at the top, or, in a ring, when the steps are
    more than there are children. If rounds are given and a child is more than rounds levels below the first, it raises.
    """
    known = roots.select(F.col("id").alias("_root")).distinct()
    first = edges.select("child", F.col("parent").alias("up")).distinct().join(known, F.col("up") == F.col("_root"), "left")
    first = first.select("child", "up", F.lit(1).cast("long").alias("d"), F.col("_root").isNotNull().alias("at_root"))
    if not recursive:
        return first.where("at_root").select("child", F.col("up").alias("root"))
    state, steps = cut(first, "closure"), 1
    n = state.select("child").distinct().count()
    while True:
        nearest = state.groupBy("child").agg(F.min(F.when(F.col("at_root"), F.col("d"))).alias("_least"))
        there = state.join(nearest, "child")
        arrived, on_way = there.where("at_root and d = _least").drop("_least"), there.where("_least is null").drop("_least")
        state = cut(arrived.unionByName(on_way), "closure")
        on_way = state.where("not at_root")
        if steps > n or on_way.limit(1).count() == 0:
            break
        above = state.select(F.col("child").alias("up"), F.col("up").alias("_up"), F.col("d").alias("_d"), F.col("at_root").alias("_at"))
        further = on_way.drop("at_root").join(above, "up").select("child", F.col("_up").alias("up"), (F.col("d") + F.col("_d")).alias("d"), F.col("_at").alias("at_root"))
        state, steps = state.where("at_root").unionByName(further.groupBy("child", "up", "at_root").agg(F.min("d").alias("d"))), 2 * steps
    found = state.where("at_root")
    if rounds is not None and (found.agg(F.max("d")).first()[0] or 0) > rounds + 1:
        raise RuntimeError(f"the closure goes on beyond {rounds} rounds")
    return found.select("child", F.col("up").alias("root"))

"""Sharding with fixed virtual slots: records hash into thousands of slots, a versioned map says which shard has a slot.

The number of slots never changes. Sizes are summed by slot, and rebalance() edits the map from those sums: a shard
that is over its share gives up slots, these go one by one to the lightest shard. Only edited slots get a row with the
new version, so the map at any version is, for each slot, the latest row up to it, and a record moves only if its slot
does. The map is a table under a path of the user's, which every later run reads and adds its edits to. DataFrame
operations alone; the map has a row for each slot and version, however many records there are.

Edge cases: a null text has no bytes; a null id hashes as the text 'null'; equal records (repeated rows, rows without id
of equal text) are numbered and spread by their numbers; with fewer records than shards some shards stay empty; an empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.llm import common

SLOTS, RECORD_BYTES = 4096, 8
MAP = "version int, virtual_slot int, shard int"


def record_key(doc_id: Column, size: Column) -> Column:
    """Records are spread by id and size."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row. The texts are read once.

    Of equal records the first has the slot of its key, the others those of the key and their number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + RECORD_BYTES
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = record_key(F.col("doc_id"), F.col("size"))
    rows = common.written(rows.withColumn("_key", F.concat_ws("/", key, "text_crc32")).withColumn("_row", F.monotonically_increasing_id()), "records")
    repeated = common.written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated_records")
    total = rows.count()
    single = common.spread_anti(rows, repeated, "_key", "_n", total).withColumn("_copy", F.lit(0).cast("long"))
    part = F.shiftright("_row", 33)  # the task that read the row, so that no hot group meets in one window
    several = common.spread_join(rows, repeated, "_key", "_n", total).withColumn("_part", part)
    copies = common.numbered(several, ["_key"], "_part", ["_row"], "_copy").select(single.columns)
    own = F.when(F.col("_copy") == 0, key).otherwise(F.concat_ws("/", key, F.col("_copy").cast("string")))
    return single.unionByName(copies).select("doc_id", "size", "text_crc32", common.md5_slot(own, slots).alias("virtual_slot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows of every slot, empty ones too."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("rows"))


def current(history: DataFrame, version: int) -> DataFrame:
    """The map at a version: virtual_slot, shard."""
    latest = F.max_by("shard", "version").alias("shard")
    return history.where(F.col("version") <= version).groupBy("virtual_slot").agg(latest)


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn, before any size is known."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(sizes: DataFrame, history: DataFrame, version: int, shards: int) -> DataFrame:
    """The rows that version + 1 adds to the map: slots that get another shard.

    A shard keeps its slots, the largest first, while they fit its even share; what it gives up, and the slots of
    shards that no longer exist, go largest first to the shard that is then the lightest (the lower number in a tie).
    """
    held = sizes.join(current(history, version), "virtual_slot", "left")
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(shards)
    largest = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_share", share).withColumn("_sum", F.sum("bytes").over(largest))
    kept = (F.col("shard") < shards) & (F.col("_sum") <= F.col("_share"))
    held = held.withColumn("kept", F.coalesce(kept, F.lit(False)))
    one = held.agg(F.sort_array(F.collect_list(F.struct("kept", "bytes", (-F.col("virtual_slot")).alias("back"), "shard")), asc=False).alias("all"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        to = F.when(slot["kept"], slot["shard"]).otherwise(lightest)
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    placed = one.select("all", F.aggregate("all", start, place)["to"].alias("to"))
    moves = placed.select(F.explode(F.arrays_zip("all", "to")).alias("m")).select((-F.col("m.all.back")).cast("int").alias("virtual_slot"), F.col("m.all.shard").alias("was"), F.col("m.to").alias("shard"))
    return moves.where(~F.col("was").eqNullSafe(F.col("shard"))).select(F.lit(version + 1).alias("version"), "virtual_slot", "shard")


def load_map(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions of the map under a path; null where there is none yet, or none whose first version was written to its end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    history = spark.read.schema(MAP).parquet(path)
    return history if history.where("version = 0").count() else None


def shard(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot: the record's place in its shard, without gaps from 0.

    map_path: where the map is kept. The first run deals slots in turn (version 0) and evens the bytes (version 1); a
    later one, with the same number of slots, reads what is there and adds a version with the slots that have to move.
    """
    spark = docs.sparkSession
    rows = common.written(records(docs, slots), "slotted_records")
    if load_map(spark, map_path) is None:
        first_map(spark, shards, slots).coalesce(1).write.mode("overwrite").parquet(map_path)
    history = load_map(spark, map_path)
    version = history.agg(F.max("version")).first()[0]
    common.written(rebalance(slot_sizes(rows, slots), history, version, shards), "slot_map_edits").write.mode("append").parquet(map_path)
    now = current(load_map(spark, map_path), version + 1)
    placed = rows.join(F.broadcast(now), "virtual_slot")  # a row for each of the fixed slots
    return common.numbered(placed, ["shard"], "virtual_slot", ["doc_id", "size", "text_crc32"], "slot")

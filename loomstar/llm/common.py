"""What the training-data operators share: tables in the shared folder, bounded label samples, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The name of a slot hash that any SQL engine can repeat: the first 32 bits of an MD5.
HEX_DIGITS = 8
#: A key is hot with more than one in so many of all rows.
HOT = 1000
#: Blocks of a hot key's rows in a salted join: a block is a hundredth of all rows, so that little of the other side is copied.
BLOCKS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() gives the same where all characters take one byte, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in smaller ones, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name with a number after it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n not in taken)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Only in local mode, where none is named, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomstar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as Parquet in the shared folder, read again. It survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomstar-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, other: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows joined to other, a written table, by a key without sending a hot key's rows to one task.

    often: a column of other, how many of the total rows have the key. A key with more than one in HOT of them is hot, so
    fewer than HOT keys are, and their side is broadcast; the others meet in a shuffle.
    """
    hot = other.where(F.col(often) * HOT > total)
    if hot.limit(1).count() == 0:
        return rows.join(other, key)
    cold = rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(other.where(F.col(often) * HOT <= total), key))


def marked_join(rows: DataFrame, other: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """spread_join, always with the hot keys marked first, so that the steps are the same on any input; other has one row of a key."""
    hot = F.col(often) * HOT > total
    columns = [F.col(c).alias(f"_{c}_hot") for c in other.columns if c != key]
    marked = rows.join(F.broadcast(other.where(hot).select(key, *columns)), key, "left")  # fewer than HOT rows
    is_hot = F.col(f"_{often}_hot").isNotNull()
    warm = marked.where(is_hot).select(key, *[c for c in rows.columns if c != key], *[F.col(f"_{c}_hot").alias(c) for c in other.columns if c != key])
    cold = marked.where(~is_hot).select(rows.columns).join(other.where(~hot), key)
    return warm.unionByName(cold)


def spread_anti(rows: DataFrame, other: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """The rows whose key isn't in other, a written table; hot keys, which are few (see spread_join), are taken out first."""
    hot = other.where(F.col(often) * HOT > total).select(key)
    if hot.limit(1).count():
        rows = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(other.select(key), key, "left_anti")


def salted_join(rows: DataFrame, other: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows joined to other, which may have many rows of a key, without sending a hot key's rows to one task or broadcasting a side.

    often: a column of other, how many of the total rows have the key. The rows of a key with more than one in BLOCKS are dealt
    to as many blocks (BLOCKS at most), and other's rows of the key are copied to each of them.
    """
    blocks = F.greatest(F.ceil(F.col(often) * BLOCKS / max(1, total)), F.lit(1)).cast("int")
    keys = written(other.groupBy(key).agg(F.max(often).alias(often)).select(key, blocks.alias("_blocks")).where("_blocks > 1"), "blocks_of_keys")
    if keys.limit(1).count() == 0:
        return rows.join(other, key)
    keys = F.broadcast(keys)  # fewer than BLOCKS
    own = F.pmod(F.xxhash64(*rows.columns), F.col("_blocks")).cast("int")
    dealt = rows.join(keys, key, "left").withColumn("_block", F.coalesce(own, F.lit(0))).drop("_blocks")
    copied = other.join(keys, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    return dealt.join(copied, [key, "_block"]).drop("_block")


def md5_slot(key: Column, slots: int) -> Column:
    """A slot of 0 to slots - 1 from the first 32 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long") % F.lit(slots)).cast("int")


def numbered(rows: DataFrame, group: list[str], slot: str, order: list[str], name: str) -> DataFrame:
    """A number without gaps from 0 for each row of a group, in the order (slot, *order).

    A window over a whole group would send a hot group to one task. Here only the rows of one slot meet; the
    numbers of earlier slots come from a table of counts with a row for each group and slot.
    """
    counts = rows.groupBy(*group, slot).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, slot, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, slot).orderBy(*order))
    joined = rows.withColumn("_within", within).join(offsets, [*group, slot])
    return joined.withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_before", "_within")


def label_sample(labels: DataFrame, label: str, training: Column, per_class: int) -> tuple[DataFrame, float]:
    """At most per_class labelled ids of each class (those with the smallest hashes) and the share of label 1 among all.

    Rows without id or label are left out; an id with several labels counts with the smallest. The share covers
    every training row, so a score can be set right for the sample's other share.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & training)
    rows = rows.groupBy("doc_id").agg(F.min(F.col(label)).cast("int").alias("label"))
    rows = rows.withColumn("_hash", F.xxhash64("doc_id"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("label in (0, 1)").collect()}
    parts = []
    for k in (0, 1):
        own = rows.where(F.col("label") == k)
        share = 3 * per_class / max(sizes.get(k, 0), 1)
        if share < 1:  # so that the sort below gets about three times what it keeps, however many rows there are
            own = own.where(F.col("_hash") < int((2 * share - 1) * 2**63))
        parts.append(own.orderBy("_hash", "doc_id").limit(per_class))
    return parts[0].unionByName(parts[1]).select("doc_id", "label"), sizes.get(1, 0) / max(1, sum(sizes.values()))


def sample_texts(docs: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, the columns and the label of one row of each sampled id: that with the least hash, if an id is repeated.

    The sample's size is bounded by its parameter, so it is broadcast, and as many rows at most are given.
    """
    rows = docs.select("doc_id", *columns).join(F.broadcast(sample), "doc_id")
    one = F.min_by(F.struct(*columns, "label"), F.xxhash64(*columns)).alias("_one")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "_one.*")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)

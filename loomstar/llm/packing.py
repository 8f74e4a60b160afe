"""Packing by optimal length buckets.

The global histogram of lengths (one row for each length up to the longest allowed, however many documents there are)
goes through a dynamic program that chooses the bucket boundaries with the least padding. Documents longer than the
longest sequence are cut into pieces, none is dropped. Inside each bucket, batches of as many sequences as the token
budget holds form by their place in a gapless numbering, which no single task makes.

Edge cases: a null or empty text is a piece of no token in the first bucket; repeated rows are packed each; an empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

LONGEST, BUCKETS, BUDGET, SLOTS = 4096, 8, 32_768, 4096
TOKEN = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words between ASCII spaces; any column of token counts can stand in its place."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most that many buckets with the least padding, by dynamic programming over the lengths.

    least[j] is the least padding of the first j lengths; a further bucket from i to j pads each of its sequences to
    the last length. In ties the smaller i is taken. The last bound is the longest length.
    """
    if not len(length):
        return []
    n = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(count * length)]).astype(np.int64)
    size, far = len(length), np.iinfo(np.int64).max // 4
    least, cuts = np.full(size + 1, far), []
    least[0] = 0
    for _ in range(min(buckets, size)):
        new, cut = np.full(size + 1, far), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = least[:j] + length[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            cut[j] = cost.argmin()
            new[j] = cost[cut[j]]
        least = new
        cuts.append(cut)
    out, j = [], size
    for cut in reversed(cuts):
        out.append(int(length[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pieces(docs: DataFrame, tokens: Column, longest: int = LONGEST) -> DataFrame:
    """doc_id, piece, n_tokens: documents over the longest sequence give several pieces."""
    rows = docs.select("doc_id", tokens.alias("_all"))
    number = F.greatest(F.lit(1), F.ceil(F.col("_all") / longest)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    return rows.select("doc_id", "piece", F.least(F.lit(longest), F.col("_all") - F.col("piece") * longest).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, tokens: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, slots: int = SLOTS) -> DataFrame:
    """doc_id, piece, n_tokens, bucket (its bound), batch (from 0 in each bucket), place (in the batch), padding."""
    cut = common.written(pieces(docs, n_tokens(F.col("text")) if tokens is None else tokens, longest), "pieces")
    histogram = sorted((r["n_tokens"], r["n"]) for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())  # longest + 1 rows at most
    bounds = boundaries(np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), buckets) or [longest]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"))
    repeated = common.written(cut.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key.alias("_key"), "_n"), "repeated_pieces")
    rows = cut.withColumn("bucket", bucket).withColumn("_own", key)
    if repeated.limit(1).count():  # rows without id or of a repeated id are dealt out by their row
        total, keyed = cut.count(), cut.withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id())
        several = common.spread_join(keyed, repeated, "_key", "_n", total).withColumn("_own", F.concat_ws("/", "_key", F.col("_row").cast("string")))
        single = common.spread_anti(keyed, repeated, "_key", "_n", total).withColumn("_own", F.col("_key"))
        rows = single.select(*cut.columns, "_own").unionByName(several.select(*cut.columns, "_own")).withColumn("bucket", bucket)
    rows = rows.withColumn("_slot", common.md5_slot(F.col("_own"), slots)).drop("_own")
    rows = common.numbered(rows, ["bucket"], "_slot", ["doc_id", "piece", "n_tokens"], "_number")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    return rows.select("doc_id", "piece", "n_tokens", "bucket", F.floor(F.col("_number") / per_batch).cast("long").alias("batch"), (F.col("_number") % per_batch).alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))

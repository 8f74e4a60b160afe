"""Benchmark decontamination: a broadcast set of hashed test n-grams meets every token window of the corpus.

Benchmark texts give windows of N consecutive words (a shorter one gives a single window of all its words), hashed and
broadcast as long as their number is within a bound, else joined by a shuffle. Every document's windows of those
lengths are hashed and looked up in one narrow pass, a hit is verified word by word, and hits are gathered by
document. Spans or whole documents can then be removed. DataFrame operations alone.

Edge cases: a null or wordless text has no words, no hits and is not contaminated, a null or wordless item has no
windows; an item without id makes hits but isn't listed; an id on several rows counts once; repeated documents get
the same result each; empty tables give an empty result, or one without hits. Further columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

N = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at most, about 200 bytes each; beyond, the windows are joined by a shuffle.
COPIES = 10_000
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """size, words, key (hash) and items (ids as text) of every distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    rows = items.select("item", "w", size.alias("size"), at.alias("at")).select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("words"))
    return rows.groupBy("words", "size").agg(F.collect_set("item").alias("items")).withColumn("key", F.xxhash64("words"))


def document_windows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, fingerprint, n_words, at, size, words and key of every window of a document; what a shuffle carries."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    rows = rows.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.size("w") >= F.col("size"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))).withColumn("words", F.slice("w", F.col("at"), F.col("size")))
    return rows.select("doc_id", "fingerprint", "n_words", "at", "size", "words", F.xxhash64("words").alias("key"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """A row for each document row and distinct position of a hit, and one without position for each document row.

    Columns: doc_id, fingerprint of the text, n_words, at (1-based), size, items. The row without position comes from
    an empty window that every text has and that is added to the set, so documents without hits need no second pass.
    """
    windows = common.written(benchmark_windows(benchmark, n), "benchmark_windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # n values at most
    spark = docs.sparkSession
    empty = spark.range(1).select(F.array().cast("array<string>").alias("b_words"), F.lit(0).alias("b_size"), F.array().cast("array<string>").alias("items"), F.xxhash64(F.array().cast("array<string>")).alias("b_key"))
    known = windows.select(F.col("words").alias("b_words"), F.col("size").alias("b_size"), "items", F.col("key").alias("b_key"))
    if windows.count() > BROADCAST_WINDOWS:  # the empty window would be one key for all documents; its rows need no join
        near = document_windows(docs, sizes)
        same = (F.col("key") == F.col("b_key")) & (F.col("size") == F.col("b_size")) & (F.col("words") == F.col("b_words"))
        marks = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(1).alias("at"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("items"))
        return near.join(known, same).select("doc_id", "fingerprint", "n_words", "at", "size", "items").unionByName(marks)
    known = F.broadcast(known.unionByName(empty))
    rows = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    # (size, last position) of the windows of each size that fit, and the empty one
    spans = F.array(F.struct(F.lit(0).alias("size"), F.lit(1).alias("last")), *[F.struct(F.lit(s).alias("size"), (F.size("w") - s + 1).alias("last")) for s in sizes])
    rows = rows.withColumn("span", F.explode(F.filter(spans, lambda x: x["last"] > 0)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("span.last")))).withColumn("size", F.col("span.size"))
    window = F.slice("w", F.col("at"), F.col("size"))
    same = (F.xxhash64(window) == F.col("b_key")) & (F.col("size") == F.col("b_size")) & (F.slice("w", F.col("at"), F.col("size")) == F.col("b_words"))
    return rows.join(known, same).select("doc_id", "fingerprint", "n_words", "at", "size", "items")


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, fingerprint, n_words, n_hit, n_items, items (sorted ids), contaminated, spans (place and size of hits).

    A word inside any occurrence of a window is hit; a document is contaminated when a twentieth of its words are.
    """
    found = hits(docs, benchmark, n)
    span = F.when(F.col("size") > 0, F.struct("at", "size"))
    by = found.groupBy("doc_id", "fingerprint", "n_words").agg(F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum((F.col("size") == 0).cast("int")).alias("copies"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    by = by.withColumn("n_hit", F.size(covered).cast("long")).withColumn("items", F.array_sort("items")).withColumn("n_items", F.size("items").cast("long"))
    by = by.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    # repeated rows again, by arrays of COPIES at most, however many there are
    by = by.withColumn("_block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    return by.withColumn("_copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - _block * {COPIES}))"))).drop("_block", "_copy", "copies")


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = judge(docs, benchmark, n).where("contaminated").select("doc_id", "fingerprint").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.fingerprint"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id and words of every document, without the words that are hit."""
    spans = judge(docs, benchmark, n).select("doc_id", "fingerprint", "spans").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), words(F.col("text")).alias("w"))
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.fingerprint") == F.col("s.fingerprint")))
    hit = lambda i: F.exists("s.spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["size"]))
    return joined.select("d.doc_id", F.filter("d.w", lambda _, i: ~hit(i)).alias("words"))

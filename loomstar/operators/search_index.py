"""Substring search by posting lists of trigrams, and within a session by parts, so that not all texts are read.

An index is a folder: documents in parts by their session's hash, each with a number, and postings (gram, document number)
in buckets by the gram's hash, sorted by gram. A search reads the buckets of its words' grams, keeps the documents that
have all of them, reads the parts that these lie in, and tests their texts as a plain search does (conversation.search),
so the rows are the same. Words of less than three characters have no gram: they are tested alone. A frequent gram's
postings are rows, not one list, and are dealt to several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.operators import conversation, links

GRAM, PARTS, SPREAD = 3, 64, 4
#: Candidates that are broadcast at most (8 bytes each and the table's overhead).
BROADCAST_CANDIDATES = 1_000_000


def bucket_of(column: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def grams_in(text: Column) -> Column:
    """The different grams of a text, found in one pass: an empty match at each place looks at the characters ahead.

    Beyond the basic plane there is a match within a character too; its gram has a ? there and is one more than needed.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def write(documents: DataFrame, folder: str) -> None:
    """Writes the index of documents (conversation.search_documents), in place of an earlier one."""
    spark = documents.sparkSession
    salt = F.pmod(F.xxhash64("content"), F.lit(SPREAD))
    rows = documents.withColumn("part", bucket_of(F.col("session_id"))).repartition("part", salt).withColumn("doc", F.monotonically_increasing_id())
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/documents")
    grams = F.explode(grams_in(F.lower("content")))
    postings = spark.read.parquet(f"{folder}/documents").select(grams.alias("gram"), "doc", F.col("part").alias("doc_part")).withColumn("bucket", bucket_of(F.col("gram")))
    dealt = postings.repartition("bucket", F.pmod("doc", F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "doc")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def grams_of(query: str) -> list[str]:
    """The different grams of a query's words, in lower case."""
    return sorted({word[i : i + GRAM] for word in query.lower().split() for i in range(len(word) - GRAM + 1)})


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """doc and doc_part of the documents that have all grams of the query; none if it has no gram."""
    grams = grams_of(query)
    if not grams:
        return None
    buckets = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(bucket_of(F.col("g"))).collect()})
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return postings.groupBy("doc", "doc_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).drop("_n")  # a gram has one row of a document


def search(spark: SparkSession, folder: str, query: str, limit: int = 100, order: tuple[str, ...] = ("id", "content"), session: str | None = None) -> DataFrame:
    """As conversation.search over the index's documents; session: only those of one session, which lie in one part."""
    documents = spark.read.parquet(f"{folder}/documents")
    if session is not None:
        part = spark.range(1).select(bucket_of(F.lit(session))).first()[0]
        documents = documents.where((F.col("part") == part) & (F.col("session_id") == session))
    elif (found := candidates(spark, folder, query)) is not None:
        found = links.cut(found, "candidates")
        parts = [r[0] for r in found.select("doc_part").distinct().collect()]  # PARTS at most
        documents = documents.where(F.col("part").isin(parts))
        if found.count() <= BROADCAST_CANDIDATES:
            found = F.broadcast(found)
        documents = documents.join(found, "doc", "left_semi")
    return conversation.search(documents.drop("part", "doc"), query, limit, order)

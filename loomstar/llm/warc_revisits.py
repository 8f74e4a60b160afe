"""WARC revisits that say not modified: each is resolved to the latest earlier full response of its canonical url.

It is an as-of join. A window over a url's records would send a hot url to one task, so a url's seconds (one row for each
that has records, with its last response) are cut into spans: a window holds the seconds of one span at most, and what
holds at a span's start comes from a table with a row for each url and span. Revisits then find their second by a join
that keeps hot ones apart. Validators are then checked (entity tags with the weak comparison, else the modification time), and the
headers that a 304 may renew are merged over the response's.

Edge cases: a record without url or time is resolved to nothing; a response of the same instant counts as earlier, of
several the one with the largest id holds; without validators on both sides the result is 'unchecked'; null headers
count as none; repeated rows are resolved each; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.llm import common

SPAN_SECONDS = 6 * 3600
#: Header fields that a 304 response doesn't renew (RFC 9111, 3.2, and the fields of a single connection).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid|sessionid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, tracking parameters or final slash; http counts as https, www. as no prefix."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.lit(2**30))
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    head = F.regexp_replace(head, r"^(?:(http://.*):80|(https://.*):443)$", "$1$2")  # the scheme's own default port
    head = F.regexp_replace(F.regexp_replace(head, r"^http://", "https://"), r"^https://www\.", "https://")
    return F.concat(head, F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def field(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, renewed by those of the revisit that may be. Names are in lower case."""
    renewed = F.map_filter(revisit, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(renewed, k)), renewed)


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """A row for each revisit of records (record_id, url, ts in seconds, kind: response or revisit, headers map).

    record_id, canonical_url, ts, response_id, response_ts, status (unresolved, match, mismatch, unchecked), headers.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", F.coalesce("headers", none).alias("headers"))
    rows = common.written(rows.withColumn("span", F.floor(F.col("ts") / span_seconds)), "captures")
    full = F.when(F.col("kind") == "response", F.struct("ts", F.col("record_id").alias("id"), "headers"))
    placed = rows.where("canonical_url is not null and ts is not null")
    known_first = F.struct(F.col("record_id").isNotNull(), F.col("record_id"))  # of the responses of a second: one with an id, the largest
    last = F.max_by(full, F.when(F.col("kind") == "response", known_first))
    seconds = placed.groupBy("canonical_url", "span", "ts").agg(last.alias("_full"), F.count_if(F.col("kind") == "revisit").alias("_n"))
    seconds = common.written(seconds, "seconds_of_urls")
    spans = seconds.groupBy("canonical_url", "span").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.col("ts"))).alias("_last"))
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    held = spans.select("canonical_url", "span", F.last("_last", ignorenulls=True).over(before).alias("_held"))
    within = Window.partitionBy("canonical_url", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    key = F.concat_ws(" ", "ts", "canonical_url").alias("_key")
    known = seconds.withColumn("_own", F.last("_full", ignorenulls=True).over(within)).join(held, ["canonical_url", "span"], "left")
    known = common.written(known.where("_n > 0").select(key, F.coalesce("_own", "_held").alias("r"), "_n"), "responses_of_seconds")
    revisits = placed.where("kind = 'revisit'").select("record_id", "canonical_url", "ts", "headers", key)
    found = common.spread_join(revisits, known, "_key", "_n", revisits.count())
    lost = rows.where("kind = 'revisit' and (canonical_url is null or ts is null)").select("record_id", "canonical_url", "ts", "headers")
    found = found.select("record_id", "canonical_url", "ts", "headers", "r").unionByName(lost, allowMissingColumns=True)
    old, new = F.col("r.headers"), F.col("headers")
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags, times = (field(old, "etag"), field(new, "etag")), (field(old, "last-modified"), field(new, "last-modified"))
    same = F.when(tags[0].isNotNull() & tags[1].isNotNull(), weak(tags[0]) == weak(tags[1])).otherwise(times[0] == times[1])
    status = F.when(F.col("r").isNull(), "unresolved").when(same.isNull(), "unchecked").when(same, "match").otherwise("mismatch")
    out = found.withColumn("status", status)
    return out.select("record_id", "canonical_url", "ts", F.col("r.id").alias("response_id"), F.col("r.ts").alias("response_ts"), "status", F.when(F.col("status").isin("match", "unchecked"), merged(old, new)).alias("headers"))


def captures(pages: DataFrame, visits: int = 3) -> DataFrame:
    """Records derived from a table of pages: a full response of each page and later revisits of it.

    A page is fetched at a time made from its id, and asked for again some hours later, each time with the tag of the
    page as it was, but for every fifth with a tag of another state.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    start = F.col("page_id") * 60
    first = pages.select((F.col("page_id") * (visits + 1)).alias("record_id"), "url", start.alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("origin")).alias("headers"))
    visit = F.explode(F.sequence(F.lit(1), F.lit(visits)))
    again = pages.select("page_id", "url", tag.alias("_tag"), visit.alias("v")).withColumn("_tag", F.when((F.col("page_id") + F.col("v")) % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("_tag"))))
    again = again.select((F.col("page_id") * (visits + 1) + F.col("v")).alias("record_id"), "url", (F.col("page_id") * 60 + F.col("v") * 5 * 3600).alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), F.col("_tag"), F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close"), F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("v") * 600), F.lit("age"), (F.col("v") * 7).cast("string")).alias("headers"))
    return first.unionByName(again)

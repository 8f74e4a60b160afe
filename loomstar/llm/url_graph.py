"""URL filters with link-graph propagation.

Rules (host and path) judge the urls they fit. The hosts of allowed and blocked urls are the seeds of two walks over
host edges: trust goes along the edges (personalised PageRank), distrust against them, until the ranks no longer change.
A host is blocked where its distrust is over its trust and over the even share of all hosts times a threshold, which
judges the urls that no rule fits.

Edges are absolute links between hosts, of weight 1 each. Hosts that link to the same site path (as pages made from one
template do) are joined through a vertex for that path, so that a path shared by many hosts isn't expanded into pairs:
all paths of a host weigh PATH_WEIGHT together, by how few hosts share each, and a path leads to its hosts evenly. A
vertex whose edges weigh less than 1 passes on so much less; the rest goes back to the seeds.

Edge cases: a null url or one without :// has an empty host and path, and no edges; hosts that no walk reaches are
allowed; a page's repeated rows are judged each, and count each as a seed and for its links; null html has no links; an
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomstar.llm import common

HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
#: Share of each step that goes on; weight of all paths of a host together (a link has 1).
DAMPING, PATH_WEIGHT = 0.85, 0.5
#: The walks end when CUT_EVERY steps change the ranks by less than this in sum; a step's change shrinks by DAMPING at least.
TOLERANCE, CUT_EVERY = 1e-8, 8
#: Distrust over this many times the even share blocks a host; ranks that differ by less than a millionth are equal.
EVEN_SHARES, MARGIN = 1.0, 1e-6


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), common.UPPER, common.LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one. A rule is a host and a path, as 'org/fr/'."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and w, the number of such links: dst is another host, or a site path, which begins with a slash."""
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("_to"))
    absolute = F.col("_to").rlike(r"(?i)^(?:https?:)?//")
    host = host_of(F.concat(F.lit("x:"), F.regexp_replace("_to", r"(?i)^https?:", "")))
    to = F.when(absolute, host).when(F.col("_to").startswith("/"), F.regexp_extract("_to", r"^([^?#]*)", 1))
    rows = rows.select("src", to.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def path_steps(links: DataFrame, n_hosts: int) -> DataFrame:
    """src, dst, w of the steps from hosts to the paths that several hosts link, but not all, and back."""
    own = links.where("startswith(dst, '/')").select(F.col("src").alias("host"), F.col("dst").alias("path"))
    often = own.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).where(f"_n > 1 and _n < {n_hosts}")
    rows = own.join(often, "path").withColumn("_rare", F.log(F.lit(float(n_hosts)) / F.col("_n")))
    total = rows.groupBy("host").agg(F.sum("_rare").alias("_all"))
    there = rows.join(total, "host").select(F.col("host").alias("src"), F.col("path").alias("dst"), (F.lit(PATH_WEIGHT) * F.col("_rare") / F.col("_all")).alias("w"))
    return there.union(rows.select("path", "host", F.lit(1.0) / F.col("_n")))


def walks(edges: DataFrame, seeds: DataFrame, both_ways: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, rank (sums to 1 in each kind) when it has settled. seeds: kind (trust, distrust), host, seed (sums to 1 in each kind).

    edges: src, dst, w, which trust takes from src to dst and distrust from dst to src. both_ways: steps that either takes as they are.
    """
    rows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").union(edges.select(F.lit("distrust"), "dst", "src", "w"))
    if both_ways is not None:
        rows = rows.union(both_ways.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))), "src", "dst", "w"))
    total = rows.groupBy("kind", "host").agg(F.greatest(F.lit(1.0), F.sum("w")).alias("_all"))
    steps = common.written(rows.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("_all")).alias("share")), "host_steps")
    seeds = common.written(seeds, "seeds")
    start = seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("rank"))
    before = rank = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for step in count(1):
        moved = rank.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
        rank = moved.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0:
            change, zero = Observation(), F.lit(0.0)
            both = rank.withColumn("_old", zero).union(before.select("kind", "host", zero, "rank")).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("_old").alias("_old"))
            both = both.observe(change, F.sum(F.abs(F.col("rank") - F.col("_old"))).alias("all")).select("kind", "host", "rank")
            before = rank = common.written(both, "ranks")
            if (change.get["all"] or 0.0) < tolerance:
                break
    return in_shares(rank)


def in_shares(rank: DataFrame) -> DataFrame:
    """Ranks that sum to 1 in each kind: what vertices pass on to none goes back to the seeds."""
    total = rank.groupBy("kind").agg(F.sum("rank").alias("_all"))  # two rows
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("_all")).alias("rank"))


def judge(pages: DataFrame, rules: dict[str, str], tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), trust and distrust of the host in even shares of all hosts."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict)
    by_host = common.written(rows.where("host <> ''").groupBy("host", "_verdict").agg(F.count(F.lit(1)).alias("n")), "verdicts_of_hosts")
    known = by_host.where("_verdict is not null")
    total = {r["_verdict"]: r["n"] for r in known.groupBy("_verdict").agg(F.sum("n").alias("n")).collect()}  # two rows
    kind = F.when(F.col("_verdict") == "allow", "trust").otherwise("distrust")
    share = F.when(F.col("_verdict") == "allow", F.col("n") / max(1, total.get("allow", 0))).otherwise(F.col("n") / max(1, total.get("block", 0)))
    links = common.written(host_links(pages), "host_links")
    between = links.where("not startswith(dst, '/')")
    n_hosts = max(1, by_host.select("host").union(between.select("dst")).distinct().count())
    ranks = walks(between, known.select(kind.alias("kind"), "host", share.alias("seed")), path_steps(links, n_hosts), tolerance)
    ranks = in_shares(ranks.where("not startswith(host, '/')")).withColumn("rank", F.col("rank") * n_hosts)
    marks = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    # only hosts with pages are marked, each with how many it has, so that a hot host isn't sent to one task
    pages_of = by_host.groupBy("host").agg(F.sum("n").alias("_n"))
    marks = common.written(pages_of.join(marks, "host", "left").fillna(0.0, ["trust", "distrust"]), "marks_of_hosts")
    some = common.spread_join(rows.where("host <> ''"), marks, "host", "_n", rows.count()).drop("_n")
    none = rows.where("host = ''").withColumn("trust", F.lit(0.0)).withColumn("distrust", F.lit(0.0))
    out = some.unionByName(none)
    over = (F.col("distrust") > F.col("trust") * (1 + MARGIN)) & (F.col("distrust") > EVEN_SHARES * (1 + MARGIN))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(over, "block").otherwise("allow")).alias("verdict"), F.round("trust", 4).alias("trust"), F.round("distrust", 4).alias("distrust"))

"""Near-duplicates by bottom-k sketches of one hash function.

1. A narrow pass hashes each text's words and shingles; texts of equal word sequences become one class.
2. The K smallest shingle hashes of a class are its sketch. Inverted lists of the values that several sketches retain
   generate overlaps. A linked pair shares at least LEAST retained values (or four fifths of a set smaller than K), so
   it meets in the list of one of the rarest K - LEAST + 1 values of each; only these are listed.
3. Each list is joined to its centre, the class with the fewest rare values, not to all its members. The share of the
   smallest K values of both sketches that both have estimates the similarity and filters; the exact Jaccard
   similarity of the full sets confirms. Links give components.
4. What a centre can't settle is done exactly: the full sets of the classes in lists that still span several
   components get lists of their own, with the prefix and place bounds that hold for every linked pair. By these the
   smaller of two linked sets has the list's value in its first ninth; such members are inner ones, and only they are
   tried with others. Rounds of CENTRES inner members (then twice as many, and so on) of each long list are tried with
   the others of other components, and leave it, until a list lies in one component or has SHORT inner members at most.
   Members of such short lists meet its inner ones, within the bounds, so each is tried with SHORT others at most.

Where a value's list is hot, its members are dealt to blocks and the inner ones copied to each (common.salted_join). In the
worst case, a hot value with as many components as members, inner members x members are still tried.

So no list is expanded into all its pairs, and no link between different texts is lost but with the chance that
two texts at the threshold share fewer than LEAST of K values (3.4e-8 for large sets). Joins by values and classes
keep hot keys apart (common.spread_join).

Edge cases: a null or wordless text is linked with nothing; equal texts are one class; repeated rows and repeated or
null ids are told apart by their row; ids are taken as long integers; a component's id is its smallest id, null if it has
none; an empty table gives an empty result. Further columns are ignored, or kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.llm import common

WORDS = 4
K, LEAST, ESTIMATE = 48, 22, 0.45
KNOWN_WORDS = 400_000
#: Ids of suspects that are broadcast at most (16 bytes each and the table's overhead); beyond, a shuffle joins them.
BROADCAST_IDS = 1_000_000
#: Inner members of a long list tried in the first round (twice as many in each further one); inner members of a short list at most.
CENTRES, SHORT = 256, 256
INNER = "9 * place <= n_shingles"
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], known: WordHashes, size: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; fewer words than size are one shingle."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    n, mixed = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[4] + h[i : i + n] * MIX[i % 4]
    mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed * MIX[0]).view(np.int64))


def sketched(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, hash of the text, fingerprint of the word sequence, n_shingles and the sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in common.slices(batches):
            prints, sizes, sketches = [], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").lower().split()
                s = shingle_hashes(words, known, size)
                prints.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sizes.append(len(s))
                sketches.append(s[:k])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fingerprint", "n_shingles", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fingerprint binary, n_shingles int, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: bool, size: int = WORDS) -> DataFrame:
    """node and full set of the wanted classes (node, and doc_id, text_hash, fingerprint of one of their rows). repeated: rows may be."""
    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("fingerprint").alias("_print"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))  # ids may be null or repeated
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, same).select("node", "_print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in common.slices(batches):
            words = [(t or "").encode("utf-8", "replace").lower().split() for t in b.column("text").to_pylist()]
            own = [i for i, (w, p) in enumerate(zip(words, b.column("_print").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(b" ".join(w)) == p]
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(own, pa.int32())), pa.array([shingle_hashes(words[i], known, size) for i in own], pa.list_(pa.int64()))], ["node", "set"])

    sets = rows.mapInArrow(run, "node long, set array<long>")
    return sets.dropDuplicates(["node"]) if repeated else sets


def four_fifths(n: Column) -> Column:
    """The least overlap of a linked pair, by the size of either set: 0.8 n, rounded up."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def lists(sets: DataFrame, column: str, k: int | None) -> DataFrame:
    """value, node, n_shingles and place (from 0, rarest values first) of the listed values that several sets have."""
    rows = sets.select("node", "n_shingles", F.size(column).alias("_held"), F.explode(column).alias("value"))
    often = common.written(rows.groupBy("value").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1"), "often")
    rows = common.spread_join(rows, often, "value", "_df", often.agg(F.sum("_df")).first()[0] or 0)
    by = Window.partitionBy("node")
    place = F.col("_held") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("_df", "value")) - 1  # values that no other has come first
    least = four_fifths(F.col("n_shingles"))
    if k is not None:
        least = F.when(F.col("n_shingles") * 5 > 4 * k, F.lit(LEAST)).otherwise(least)  # a linked set may be larger than a sketch
    return rows.withColumn("place", place.cast("int")).where(F.col("place") <= F.col("_held") - least).select("value", "node", "n_shingles", "place")


def alike_sizes(a: str, b: str) -> Column:
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 x intersection >= 80 x union."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared * 100 >= (F.size("_a") + F.size("_b") - shared) * 80).select("a", "b")


def estimated(pairs: DataFrame, reps: DataFrame, k: int = K) -> DataFrame:
    """The pairs whose union sketch, the k smallest values of both, has ESTIMATE of its values in both sketches."""
    one = pairs.join(reps.select(F.col("node").alias("a"), F.col("sketch").alias("_a")), "a")
    both = one.join(reps.select(F.col("node").alias("b"), F.col("sketch").alias("_b")), "b")
    union = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, k)
    shared = F.array_intersect(F.array_intersect("_a", "_b"), union)
    return both.where(F.size(shared) >= F.size(union) * ESTIMATE).select("a", "b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every linked node, by alternating large and small stars; raises if they haven't settled."""
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("m", "u"))
        large = common.spread_join(both, common.written(least, "least"), "u", "_n", 2 * (before[0] if before else edges.count())).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = common.written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the stars haven't settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each row, its text_hash and component (null without words)."""
    rows = common.written(sketched(docs, size, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("fingerprint").agg(F.min(F.struct("row", "doc_id", "text_hash", "n_shingles", "sketch")).alias("r"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    reps = common.written(classes.select(F.col("r.row").alias("node"), F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), "fingerprint", F.col("r.n_shingles").alias("n_shingles"), F.col("r.sketch").alias("sketch"), "least_id", "copies"), "classes")

    listed = common.written(lists(reps, "sketch", k), "lists")
    star = common.written(estimated(stars(listed), reps, k), "pairs")
    suspects = listed.select("node").distinct()
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    sets = common.written(full_sets(docs, reps.join(suspects, "node"), repeated, size), "sets")
    links = common.written(confirmed(star, sets), "confirmed")
    first = common.written(components(links), "components")

    labelled = common.written(listed.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    open_lists = labelled.groupBy("value").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("value")
    open_nodes = labelled.join(open_lists, "value").select("node", "n_shingles", "component").distinct()
    open_sets = sets.join(open_nodes, "node")
    exact = common.written(lists(open_sets, "set", None), "exact_lists")
    final = settled(exact, links, first, sets)

    label = reps.join(final, "node", "left").select("fingerprint", "least_id", "copies", F.coalesce("component", "node").alias("component"))
    label = common.written(label, "components_of_classes")
    least = common.written(label.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("_n")), "least_ids")
    label = common.spread_join(label, least, "component", "_n", label.count()).select("fingerprint", "component", "component_id", "copies")
    label = common.written(label, "labels")
    some, none = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    out = common.spread_join(some, label, "fingerprint", "copies", rows.count()).drop("copies")
    out = out.unionByName(none.withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "text_hash", "component")


def settled(exact: DataFrame, links: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Components after all links that the exact lists hold: rounds of centres in long lists, then pairs in the short ones."""
    for step in count():
        apart = exact.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        state = apart.groupBy("value").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count_if(F.expr(INNER)).alias("_inner"), F.count(F.lit(1)).alias("_n")).where("_a <> _b and _inner > 0")
        state = common.written(state.select("value", "_inner", "_n"), "open_lists")
        total = exact.count()
        apart = common.written(common.spread_join(apart, state, "value", "_n", total), "apart")
        long = apart.where(F.col("_inner") > SHORT)
        if long.limit(1).count() == 0:
            break
        centre = common.written(centres(long.where(INNER), CENTRES << step), "centres")
        more = common.written(confirmed(tried(long, centre, total), sets), "confirmed")
        if more.limit(1).count():
            links = links.union(more)
            found = common.written(components(links), "components")
        exact = apart.join(centre.select("value", F.col("x").alias("node")), ["value", "node"], "left_anti").select("value", "node", "n_shingles", "place")
    return components(links.union(confirmed(tried(apart, as_inner(apart.where(INNER)), total), sets)))


def as_inner(rows: DataFrame) -> DataFrame:
    """Members as one side of a pair: value, x, xc, xn, xp, and _n, the members of the list."""
    return rows.select("value", F.col("node").alias("x"), F.col("component").alias("xc"), F.col("n_shingles").alias("xn"), F.col("place").alias("xp"), "_n")


def centres(listed: DataFrame, number: int) -> DataFrame:
    """At most number members of each list, as_inner: those whose own values are the least rare among those of equal hash."""
    part = F.pmod(F.xxhash64("node"), F.lit(number))
    best = listed.groupBy("value", part.alias("_part")).agg(F.min(F.struct("place", "node", "n_shingles", "component")).alias("c"), F.max("_n").alias("_n"))
    return as_inner(best.select("value", "c.place", "c.node", "c.n_shingles", "c.component", "_n"))


def tried(listed: DataFrame, inner: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of inner members (as_inner) and of members of other components of their lists that the place bound allows."""
    need = F.col("xn") + F.col("n_shingles")  # 9 x overlap >= 4 x sum of the sizes, where J >= 0.8
    bound = (F.least(F.col("xn") - F.col("xp"), F.col("n_shingles") - F.col("place")) * 9 >= need * 4) & alike_sizes("xn", "n_shingles")
    pairs = common.salted_join(listed.drop("_n"), inner, "value", "_n", total).where((F.col("component") != F.col("xc")) & bound)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def stars(listed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members with its centre, the member whose own values are the least rare."""
    centre = listed.groupBy("value").agg(F.min(F.struct("place", "node", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    pairs = common.spread_join(listed, common.written(centre, "centres"), "value", "_n", listed.count()).where(F.col("node") != F.col("c.node"))
    pairs = pairs.where(alike_sizes("n_shingles", "c.n_shingles"))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = WORDS, k: int = K) -> DataFrame:
    """One document of each component, with all its columns: one with the component's id. Rows without id stay, other repeats of an id and text go.

    Documents are told apart by id and text; where several texts of a component have its id, that with the least hash stays.
    """
    pair = ["doc_id", "text_hash"]
    found = common.written(near_duplicates(docs, size, k).select(*pair, "component", "kept"), "kept").where("doc_id is not null")
    kept = found.where("kept")
    least = kept.where("component is not null").groupBy("component").agg(F.min("text_hash").alias("_least"), F.max("text_hash").alias("_most")).where("_least <> _most")
    surplus = kept.join(least, "component").where(F.col("text_hash") != F.col("_least")).select(*pair)
    dropped = found.where(~F.col("kept")).select(*pair).union(surplus).distinct()
    text_hash = F.xxhash64("d.text")
    left = docs.alias("d").join(dropped.alias("r"), (F.col("d.doc_id") == F.col("r.doc_id")) & (text_hash == F.col("r.text_hash")), "left_anti")
    repeated = kept.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        name = common.free_name(docs, "text_hash")
        some = left.where("doc_id is not null").withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)
        left = some.unionByName(left.where("doc_id is null"))
    return left

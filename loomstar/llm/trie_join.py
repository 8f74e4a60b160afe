"""N-gram Jaccard join by prefix trees: documents whose sets of WORDS-word shingles have a similarity of 0.9 or more.

Two sets link if 19 x overlap >= 9 x the sum of their sizes. In any global order of shingles, the first that they share is
among the first n - ceil(0.9 n) + 1 of each (its prefix), and among the first n / 19 + 1 of the smaller one.

1. Equal sets are one class. Who can have a partner at all is told by a part of the shingles: those of the smallest SHARE of
   all hashes, in any case as many as the prefix has. In the order (how many classes have it, hash) those of one class come
   first, so a class with as many of them as its prefix is long shares none of its prefix, and is done.
2. The rest are few. Their whole sets are ordered by (classes that have it, hash), rarest first; their prefixes give
   lists of the classes that have a shingle in their prefix.
3. In a list, sets are in a trie from the list's shingle on: the DEPTH next shingles in the global order. A set
   walks it once for all sets that share the path: it carries its place, the overlap so far and both sides'
   misses, and leaves a subtree if what remains of it or of the subtree's longest set can't reach the overlap that the subtree's
   shortest set needs, or if the whole subtree is of its own component. Shingles before the list's count as missed: a pair that
   shares one of them is found in that one's list. DEPTH shingles tell little of sets of thousands, so a pair must also pass the
   bitmap bound: bits that are odd in one set's bitmap alone are no more than the shingles that the sets don't share, of which a
   linked pair has (n + m) / 19 at most. What is left is confirmed on whole sets.
4. First each class walks the tries of its HOMES rarest lists, for one partner in each; links give components. Then lists that
   still span components are done in whole: members of different components, the smaller one among its first n / 19.

Lists of any size are cut: a trie has BLOCK members at most, and BLOCK others walk it in one group. In a list the largest component
is kept apart, as its members needn't meet each other; so a list of m members of which k are of other components takes
about k x m / BLOCK copies. With as many components as members that is quadratic, over BLOCK; the pairs that are confirmed are
only those that pass all bounds.

Edge cases: a null or wordless text is linked with nothing; sets of less than nine shingles link with equal ones alone;
repeated rows and repeated or null ids are told apart by their row; a component's id is its smallest id, null if it has none
(and the row's own id for a text without words); an empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.llm import common
from loomstar.llm.neardup import BROADCAST_IDS, WordHashes, components, shingle_hashes

WORDS = 3
SHARE, LEAST_SET = 0.2, 9
HOMES, DEPTH, BLOCK = 3, 96, 512
#: The smallest hashes as signed numbers.
SMALL = int((2 * SHARE - 1) * 2**63)


def prefix(n: int) -> int:
    """How many shingles of a set of n, from the first, hold one of any linked set: n - ceil(0.9 n) + 1."""
    return n - (9 * n + 9) // 10 + 1


def prefix_column(n: Column) -> Column:
    return n - F.floor((n * 9 + 9) / 10) + 1


def bitmap(s: np.ndarray) -> bytes:
    """For each remainder of the hashes whether an odd number of them has it; a power of two of bits, more than half the set's size."""
    size = 1 << max(6, (len(s) // 2).bit_length())
    return np.packbits((np.bincount(s & (size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: tuple[int, int], n: int, b: tuple[int, int], m: int) -> bool:
    """Whether sets of n and m can link, by their bitmaps (as a number, and its bits); the longer one is folded to the shorter one's bits."""
    (x, i), (y, j) = sorted((a, b), key=lambda k: k[1])
    while j > i:
        j //= 2
        y = (y >> j) ^ (y & ((1 << j) - 1))
    return 19 * (x ^ y).bit_count() <= n + m


def sampled(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, hash of the text, fingerprint of the set, n_shingles and the set's smallest hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in common.slices(batches):
            prints, sizes, parts = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_hashes((text or "").encode("utf-8", "replace").lower().split(), known, size)
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                few = len(s) < LEAST_SET
                parts.append(s[:0] if few else s[: max(prefix(len(s)), int(np.searchsorted(s, SMALL)))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fingerprint", "n_shingles", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fingerprint binary, n_shingles int, part array<long>")


def with_partners(reps: DataFrame) -> DataFrame:
    """The classes of which some shingle of the prefix, by the order over the parts, is in another class's part."""
    tokens = reps.select("node", F.explode("part").alias("value"))
    alone = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("node")).where("_n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
    rows = reps.where(F.col("n_shingles") >= LEAST_SET).select("node", "doc_id", "text_hash", "n_shingles")
    return rows.join(alone, "node", "left").where(F.coalesce("_alone", F.lit(0)) < prefix_column(F.col("n_shingles"))).drop("_alone")


def whole_sets(docs: DataFrame, wanted: DataFrame, repeated: bool, size: int = WORDS) -> DataFrame:
    """node, whole set and its bitmap of the wanted classes (node, and doc_id and text_hash of one of their rows). repeated: rows may be."""
    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in common.slices(batches):
            sets = [shingle_hashes((t or "").encode("utf-8", "replace").lower().split(), known, size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.binary())], ["node", "set", "bits"])

    sets = rows.mapInArrow(run, "node long, set array<long>, bits binary")
    return sets.dropDuplicates(["node"]) if repeated else sets


def prefixes(sets: DataFrame) -> DataFrame:
    """node, n, bits and own, the shingles of its prefix and the DEPTH after it that other sets have: (place, often, value), by place."""
    rows = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("value"))
    often = common.written(rows.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    rows = common.marked_join(rows, often, "value", "often", often.agg(F.sum("often")).first()[0] or 0)
    by = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("often", "value")) - 1  # those that no other has come first
    rows = rows.withColumn("place", place.cast("int")).where(F.col("place") < prefix_column(F.col("n")) + DEPTH)
    own = rows.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("place", "often", "value"))).alias("own"))
    return own.join(sets.select("node", "bits"), "node")


def in_prefix() -> Column:
    return F.filter("own", lambda x: x["place"] < prefix_column(F.col("n")))


def listed(own: DataFrame, most: int | None = None) -> DataFrame:
    """value, node, component, n, bits, place and the next DEPTH shingles (often and value) of each list's members; most: from how many of a prefix's first."""
    keys = in_prefix()
    place = F.posexplode(F.slice(keys, 1, most) if most else keys).alias("_at", "_own")
    rows = own.select("node", "component", "n", "bits", "own", place)
    rest = F.slice("own", F.col("_at") + 2, F.lit(DEPTH))
    return rows.select(F.col("_own.value").alias("value"), "node", "component", "n", "bits", F.col("_own.place").alias("place"), F.transform(rest, lambda x: x["often"].cast("long")).alias("often"), F.transform(rest, lambda x: x["value"]).alias("values"))


class Trie:
    """Sets by their shingles from a list's on. low, high: the smallest and largest set below; first: the smallest place; component: of all below, else None."""

    __slots__ = ("kids", "low", "high", "first", "component", "ends")

    def __init__(self) -> None:
        self.kids: dict[int, Trie] = {}
        self.low, self.high, self.first, self.component, self.ends = 1 << 60, 0, 1 << 60, -1, []

    def add(self, node: int, component: int, n: int, place: int, shingles: list[int], bits: tuple[int, int] | None = None) -> None:
        at = self
        for s in [None, *shingles]:
            if s is not None:
                at = at.kids.setdefault(s, Trie())
            at.component = component if at.component in (-1, component) else None
            at.low, at.high, at.first = min(at.low, n), max(at.high, n), min(at.first, place)
        at.ends.append((node, component, n, place, bits))

    def partners(self, node: int, component: int, n: int, place: int, shingles: list[int], every: bool, bits: tuple[int, int] | None = None) -> Iterator[int]:
        """Sets of other components, no larger than this one, that the bounds allow; every: all of them, else one."""
        last = shingles[-1] if shingles else -1
        stack = [(self, 0, 0, 0)]  # the trie, own shingles passed, the path's shingles passed, those in common
        while stack:
            trie, passed, depth, common_ = stack.pop()
            left = 19 * (n - place - passed + common_)  # 19 x the overlap that own misses leave
            missed = depth - common_
            if trie.component == component or trie.low > n or left < 9 * (n + trie.low) or 10 * trie.high < 9 * n + 19 * (trie.first + missed):
                continue
            for other, its, m, first, theirs in trie.ends:
                if its != component and m <= n and left >= 9 * (n + m) and 10 * m >= 9 * n + 19 * (first + missed) and (bits is None or theirs is None or may_link(bits, n, theirs, m)):
                    yield other
                    if not every:
                        return
            found = []
            for s, kid in trie.kids.items():
                if s > last:  # what this set has there isn't known
                    stack.append((kid, passed, depth, common_))
                    continue
                at = bisect_left(shingles, s, passed)
                if shingles[at] == s:
                    found.append((kid, at + 1, depth + 1, common_ + 1))
                else:
                    stack.append((kid, at, depth + 1, common_))
            stack += found  # what is shared is walked first


def walked(groups: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """Pairs (a, b) of a group's tries and walkers. groups: keys, inside (is in the trie), walks, and listed()'s columns."""
    dealt = groups.select(*keys, "inside", "walks", "node", "component", "n", "place", "often", "values", "bits").repartition(*keys).sortWithinPartitions(*keys)

    def pairs(members: list[tuple]) -> Iterator[tuple[int, int]]:
        trie = Trie()
        members = [(inside, walks, (*own, [(o << 64) + v + (1 << 63) for o, v in zip(often, values, strict=True)]), (int.from_bytes(bits, "little"), 8 * len(bits))) for inside, walks, *own, often, values, bits in members]
        for inside, _, own, bits in members:
            if inside:
                trie.add(*own, bits)
        for _, walks, own, bits in members:
            if walks:
                yield from ((own[0], other) for other in trie.partners(*own, every, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, was, k = [], None, len(keys)
        for b in common.slices(batches, 2048):
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:k] != was:
                    found += pairs(held)
                    held, was = [], row[:k]
                held.append(row[k:])
            yield table_of(found)
        yield table_of(list(pairs(held)))

    def table_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the whole sets link."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_b")), "b")
    return both.where(F.size(F.array_intersect("_a", "_b")) * 19 >= (F.size("_a") + F.size("_b")) * 9).select("a", "b")


def first_partners(own: DataFrame) -> DataFrame:
    """Pairs of each class with one other in each of its HOMES rarest lists, which are dealt out to blocks."""
    rows = listed(own.withColumn("component", F.col("node")), HOMES)
    sizes = common.written(rows.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "home_lists")
    rows = common.spread_join(rows, sizes, "value", "_n", rows.count())
    block = F.pmod(F.xxhash64("node", "value"), F.ceil(F.col("_n") / BLOCK)).cast("int")
    return walked(rows.withColumns({"block": block, "inside": F.lit(True), "walks": F.lit(True)}), ["value", "block"], every=False)


def across(own: DataFrame) -> DataFrame:
    """All pairs of different components that the lists allow, of lists that span some: own has each class's component."""
    light = own.select("component", "n", F.explode(in_prefix()).alias("_own")).select(F.col("_own.value").alias("value"), "component", (F.col("_own.place") * 19 <= F.col("n")).cast("long").alias("_inner"))
    shares = common.written(light.groupBy("value", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("_inner").alias("_inner")), "shares_of_lists")
    most = F.max(F.struct("_n", "_inner", "component"))
    lists = shares.groupBy("value").agg(most.alias("_most"), F.sum("_n").alias("_n"), F.sum("_inner").alias("_inner"), F.count(F.lit(1)).alias("_components"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main, main_inner, few_inner = F.col("_most._n"), F.col("_most._inner"), F.col("_inner") - F.col("_most._inner")
    lists = lists.where("_components > 1 and _inner > 0").select(
        "value", F.col("_n").alias("_members"), F.col("_most.component").alias("_main"),
        blocks(few_inner).alias("_tries0"), blocks(F.col("_n")).alias("_walks0"), blocks(main_inner).alias("_tries1"), blocks(F.col("_n") - main).alias("_walks1"),
    )
    lists = common.written(lists, "open_lists")
    rows = common.spread_join(listed(own), lists, "value", "_members", shares.agg(F.sum("_n")).first()[0] or 0)
    rows = rows.withColumn("_hash", F.xxhash64("node", "value"))
    # kind 0: tries of the other components' inner members, walked by all; 1: tries of the main component's, walked by the others
    roles = """concat(
        if(not main and inner, transform(sequence(0, _walks0 - 1), j -> named_struct('kind', 0, 'i', pmod(_hash, _tries0), 'j', bigint(j), 'inside', true)), array()),
        if(_tries0 > 0, transform(sequence(0, _tries0 - 1), i -> named_struct('kind', 0, 'i', bigint(i), 'j', pmod(_hash, _walks0), 'inside', false)), array()),
        if(main and inner, transform(sequence(0, _walks1 - 1), j -> named_struct('kind', 1, 'i', pmod(_hash, _tries1), 'j', bigint(j), 'inside', true)), array()),
        if(not main and _tries1 > 0, transform(sequence(0, _tries1 - 1), i -> named_struct('kind', 1, 'i', bigint(i), 'j', pmod(_hash, _walks1), 'inside', false)), array()))"""
    rows = rows.withColumns({"main": F.col("component") == F.col("_main"), "inner": F.col("place") * 19 <= F.col("n")}).withColumn("_role", F.explode(F.expr(roles)))
    groups = rows.select("*", "_role.*").withColumn("walks", ~F.col("inside"))
    return walked(groups, ["value", "kind", "i", "j"], every=True)


def join_classes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    rows = common.written(sampled(docs, size).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = rows.where("n_shingles > 0").groupBy("fingerprint").agg(F.min(F.struct("row", "doc_id", "text_hash", "n_shingles", "part")).alias("r"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    reps = common.written(classes.select(F.col("r.row").alias("node"), F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), "fingerprint", F.col("r.n_shingles").alias("n_shingles"), F.col("r.part").alias("part"), "least_id", "copies"), "classes")

    wanted = common.written(with_partners(reps), "with_partners")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    sets = common.written(whole_sets(docs, wanted, repeated, size), "sets")
    own = common.written(prefixes(sets), "prefixes")
    links = common.written(confirmed(first_partners(own), sets), "links")
    found = common.written(components(links), "components")
    placed = common.written(own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    more = common.written(confirmed(common.written(across(placed), "pairs"), sets), "more_links")
    final = components(links.union(more)) if more.limit(1).count() else found

    label = reps.join(final, "node", "left").select("fingerprint", "least_id", "copies", F.coalesce("component", "node").alias("component"))
    label = common.written(label, "components_of_classes")
    least = common.written(label.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("_n")), "least_ids")
    label = common.written(common.spread_join(label, least, "component", "_n", label.count()).select("fingerprint", "component_id", "copies"), "labels")
    some = common.spread_join(rows.where("n_shingles > 0"), label, "fingerprint", "copies", rows.count())
    out = some.select("doc_id", "n_shingles", "component_id").union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")

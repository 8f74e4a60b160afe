"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run of period q is a stretch of at least max(LEAST, 3 q) words in which words q apart are equal, q is the smallest
such number, and no neighbouring word extends it. Each of its words is in it three times at least. So:

1. A word that occurs less than three times in its segment (at first: the text) can't be in a run of it, and splits it;
   pieces shorter than LEAST go. The counts are taken again in the pieces, until nothing changes. All texts of a slice
   are split at once, as arrays of word numbers.
2. A surviving segment is scanned by lags. Lags under BLOCK are all compared. A run of a lag q with B <= q < 2 B holds a
   block of B words that begins at a multiple of B and comes again q words on; so for each power of two B, block hashes
   (from those of half the length) tell the lags that can have runs, in a few array operations. Only these are
   compared, word by word, so a hash that collides costs time and nothing else. A block inside a run already
   found tells nothing of multiples of its period, and is passed over.

Long texts cost about n log n, and memory in proportion to a slice of texts of SLICE_BYTES (or to one longer text).

Edge cases: a null, empty or wordless text has no runs and collapses to an empty text; repeated rows and ids are judged
row by row; null ids are kept; an empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, PERIODS = 24, 3
BLOCK = 8
SLICE_BYTES = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = "runs array<struct<start: long, length: long, period: long>>"


def surviving(ids: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and the segment of each, that are left when words rarer than PERIODS in their segment split it, to stability."""
    at = np.arange(len(ids))
    while len(at):
        key = segment * (int(ids.max()) + 1) + ids[at]
        _, own, often = np.unique(key, return_inverse=True, return_counts=True)
        keep = often[own] >= PERIODS
        at, was = at[keep], segment[keep]
        if not len(at):
            break
        new = np.concatenate([[0], np.cumsum((np.diff(at) > 1) | (np.diff(was) > 0))])
        long = np.bincount(new)[new] >= LEAST
        if keep.all() and long.all():
            return at, new
        at, segment = at[long], new[long]
    return at, segment[:0]


def stretches(words: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """Start and length of the longest stretches in which words lag apart are equal, if long enough for a run."""
    same = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + lag
    enough = lengths >= max(LEAST, PERIODS * lag)
    yield from zip(starts[enough].tolist(), lengths[enough].tolist(), strict=True)


def repeated_blocks(hashes: np.ndarray, size: int, most: int, found: list[tuple[int, int, int]]) -> list[int]:
    """Lags from size to 2 size - 1 (most at most) at which a block that begins at a multiple of size comes again."""
    rows = len(hashes) // size
    whole = hashes[: rows * size].reshape(rows, size)
    again = whole[1:] == whole[:-1, :1]
    rest = hashes[rows * size :]
    if rows and len(rest):  # the last anchor's later blocks, as far as there are any
        last = np.zeros((1, size), bool)
        last[0, : len(rest)] = rest == whole[-1, 0]
        again = np.concatenate([again, last])
    for start, length, period in found:
        first = -(-start // size)
        for k in range(first, len(again)):
            room = start + length - (k + 2) * size  # the largest lag - size that stays inside the run
            if room < 0:
                break
            cut = slice(-size % period, room + 1, period)
            if room >= size - 1:  # so it does for all anchors up to the last that has as much room
                full = min(len(again), (start + length - size + 1) // size - 1)
                if full > k:
                    again[k:full, cut] = False
                    for j in range(full, min(len(again), full + 2)):
                        room = start + length - (j + 2) * size
                        if room >= 0:
                            again[j, slice(-size % period, room + 1, period)] = False
                    break
            again[k, cut] = False
    lags = size + np.flatnonzero(again.any(axis=0))
    return lags[lags <= most].tolist()


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a segment."""
    found: list[tuple[int, int, int]] = []
    ends: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of a period; both ascend

    def inside(start: int, end: int, period: int) -> bool:
        at = bisect_right(ends[period][0], start)
        return at > 0 and ends[period][1][at - 1] >= end

    def scan(lag: int) -> None:
        divisors, own = [p for p in ends if lag % p == 0], ([], [])
        for start, length in stretches(words, lag):
            if not any(inside(start, start + length, p) for p in divisors):
                found.append((start, length, lag))
                own[0].append(start)
                own[1].append(start + length)
        if own[0]:
            ends[lag] = own

    most = len(words) // PERIODS
    for lag in range(1, min(BLOCK, most + 1)):
        scan(lag)
    hashes, size = (words.astype(np.uint64) + np.uint64(1)) * MIX, 1
    while size <= most:
        if size >= BLOCK:
            for lag in repeated_blocks(hashes, size, most, list(found)):
                scan(lag)
        left = hashes[:-size]
        hashes = ((left ^ (left >> np.uint64(29))) * MIX + hashes[size:]) * MIX
        size *= 2
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as word numbers, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.int64), *texts])
    at, segment = surviving(ids, np.repeat(np.arange(len(texts)), np.diff(begins)))
    if len(at):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(at)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first = int(at[a])
            text = int(np.searchsorted(begins, first, side="right")) - 1
            found[text] += [(first - int(begins[text]) + s, n, p) for s, n, p in lag_scan(ids[at[a:b]])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: those that no run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow's batches in slices of about SLICE_BYTES of texts, one text at least."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0))
        part, at = np.cumsum(sizes) // SLICE_BYTES, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]:
            if end > at:
                yield b.slice(at, end - at)
            at = end


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row, its n_words, its runs (start, length, period; by start, then period) and its text collapsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            numbers: dict[bytes, int] = {}
            texts, ids = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()], []
            for text in texts:
                words = text.split()
                ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            runs = runs_of(ids)
            left = [collapsed(t.split(), r).decode("utf-8") for t, r in zip(texts, runs, strict=True)]
            spans = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([len(i) for i in ids], pa.int64()), spans, pa.array(left, pa.string())], [*keep, "n_words", "runs", "collapsed"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long", RUNS, "collapsed string"]))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of each tenth row (by the id's crc32) begin to repeat somewhere; rows without id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    rows = rows.withColumn("_g", g).withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0, cast(_n - 1 as int)), i -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """Of a column of runs by start and period, that of the greatest length by period, compared as products (the first of equals); null without runs."""
    kind = "struct<start: long, length: long, period: long>"
    return F.expr(f"aggregate({runs}, cast(null as {kind}), (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))")

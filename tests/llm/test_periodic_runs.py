"""Periodic runs: segments and lags against every lag of every text, by definition."""

import hashlib
import random
import zlib

import numpy as np

from loomstar.llm import QUERIES, periodic_runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 3)):
        period = [rng.randrange(rng.choice([2, 9, 40])) for _ in range(rng.randint(1, 30))]
        at = rng.randint(0, len(w))
        w[at:at] = (period * 100)[: rng.randint(10, 100)]
    return w


def test_runs_equal_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        texts = [planted(rng) for _ in range(3)]
        assert periodic_runs.runs_of([np.array(w, np.int64) for w in texts]) == [brute_runs(w) for w in texts]
    assert periodic_runs.runs_of([]) == []


def test_long_texts_with_short_periods_in_long_ones():
    w = ([0] * 100 + [1]) * 300
    got = periodic_runs.runs_of([np.array(w, np.int64)])[0]
    assert [r for r in got if r[2] > 1] == [(0, len(w), 101)] and sum(r[2] == 1 for r in got) == 300


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), n)


def test_query_equals_brute_force_on_odd_texts(spark, tmp_path):
    rng = random.Random(7)
    texts = ["", None, " \t\n", "one two", "a " * 24, "a " * 23, " x " * 30, "A a " * 15, "é è " * 40 + "tail", "the quick  brown\x0bfox\x0c" * 9, " ".join(f"w{i % 977}" for i in range(3000))]
    texts += [" ".join(f"t{x}" for x in planted(rng)) for _ in range(150)]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)] + [(None, "b " * 40, "", "", ""), (5, "other text of an id", "", "", ""), (4, texts[4], "clash", "clash", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, _words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    key = lambda r: tuple(map(str, r))
    want = sorted((brute_row(r[0], r[1]) for r in rows), key=key)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 50 and any(r[1] > 1 for r in want)


def test_slices_by_bytes_lose_no_row(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"x{i % 3} " * 30) for i in range(200)], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, periodic_runs.periodic_runs(docs).collect()))
    assert len(want) == 200 and sum("period=1" in x for x in want) == 171
    assert want == sorted(map(str, periodic_runs.periodic_runs(docs.repartition(7)).collect()))

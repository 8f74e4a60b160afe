"""The prefix-tree join against all pairs, near its threshold and over lists cut to many blocks."""

import random
from collections import defaultdict

import pytest

from loomstar.llm import QUERIES, trie_join


def shingles(text, size=trie_join.WORDS):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs):
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b) if a and b else 0
            if both and both * 100 >= (len(a) + len(b) - both) * 90:
                links += 1
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        ids[find(i)].append(doc_id)
    rows = [(doc_id, len(s), doc_id if not s else min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((doc_id, _), s) in enumerate(zip(docs, sets, strict=True))]
    return rows, links


def near_threshold(seed=11):
    """Groups whose members differ in about a tenth of their shingles, over one base, with private and with shared changes."""
    rng, texts = random.Random(seed), []
    for g in range(12):
        n = rng.choice([9, 11, 12, 20, 40, 90, 200])
        base = [f"g{g}w{i}" for i in range(n)]
        marks = [f"g{g}m{i}" for i in range(6)]  # changes that several members share
        for k in range(rng.randint(2, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, n // 60, n // 40])):
                at = rng.randrange(len(w))
                change = rng.random()
                w[at : at + (change < 0.8)] = [rng.choice(marks) if change < 0.5 else f"own{g}x{k}y{at}"] if change < 0.9 else []
            texts.append(" ".join(w[: rng.choice([len(w), len(w), len(w) - 1, len(w) - n // 12])]))
    common_ = " ".join(f"footer{i}" for i in range(60))
    texts += [f"{' '.join(f'h{k}z{i}' for i in range(rng.randint(0, 8)))} {common_}" for k in range(40)]  # mostly a shared passage
    texts += ["", None, " \n", "a", "a b", "A  B", "a b c", "a b c d", "a b c d", "x " * 40, "x " * 41, " ".join(f"w{i % 977}x{i}" for i in range(20_000))]
    texts += [texts[-1] + " tail", texts[-1]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = [(None if i % 37 == 5 else i if i % 41 else 7, t) for i, t in zip(ids, texts, strict=True)]
    return docs + docs[:15] + [(None, None), (None, "null id here now")]


key = lambda r: tuple(map(str, r))


@pytest.mark.parametrize(("block", "depth", "homes"), [(512, 64, 3), (2, 3, 1), (3, 1, 0)])
def test_join_equals_all_pairs(spark, monkeypatch, block, depth, homes):
    for name, value in (("BLOCK", block), ("DEPTH", depth), ("HOMES", homes)):
        monkeypatch.setattr(trie_join, name, value)
    docs = near_threshold()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, component string, node int")
    if homes:
        got = trie_join.join_classes(df)
    else:  # without first partners, all links come from the lists that span components
        monkeypatch.setattr(trie_join, "first_partners", lambda own: own.selectExpr("node as a", "node as b").limit(0))
        got = trie_join.join_classes(df)
    want, links = brute(docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert links > 200 and len({r[2] for r in want}) > 60


def test_trie_leaves_what_cannot_link():
    rng, trie = random.Random(2), trie_join.Trie()
    sets = [(k, k % 5, n := rng.randint(9, 60), rng.randint(0, n // 10), sorted(rng.sample(range(80), rng.randint(0, 12)))) for k in range(60)]
    for s in sets:
        trie.add(*s)
    for node, component, n, place, own in sets:
        got = set(trie.partners(node, component, n, place, own, True))
        for other, its, m, first, theirs in sets:
            last = min(own[-1] if own else -1, theirs[-1] if theirs else -1)
            both = len({*own} & {*theirs})
            mine, missed = sum(s <= last for s in own) - both, sum(s <= last for s in theirs) - both
            fits = 19 * min(n - place - mine, m - first - missed) >= 9 * (n + m)
            if its != component and m <= n and fits:
                assert other in got
            elif its == component or m > n:
                assert other not in got
        assert set(trie.partners(node, component, n, place, own, False)) <= got


def test_query_on_equal_sets_of_other_words(spark, tmp_path):
    a, b = "p q r p q r p q r", "p q r p q r p q r p q r"  # other words, the same set
    docs = [(1, a), (2, b), (3, "p q r p")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["op13_trie_join"](spark, str(tmp_path)).collect())) == [(1, 3, 1), (2, 3, 1), (3, 2, 3)]


def test_long_sets_that_share_much_are_told_by_their_bitmaps(spark, monkeypatch):
    """Sets of thousands outlive the walk of DEPTH shingles, though none of them links."""
    rng = random.Random(4)
    parts = [[f"p{k}w{i}" for i in range(100)] for k in range(40)]
    docs = [(i, " ".join(w for k in sorted(rng.sample(range(40), 25)) for w in parts[k])) for i in range(40)]
    docs += [(40, docs[0][1] + " some more words"), (41, docs[1][1] + " and others here")]
    tried, confirmed = [], trie_join.confirmed
    monkeypatch.setattr(trie_join, "confirmed", lambda pairs, sets: tried.append(pairs.count()) or confirmed(pairs, sets))
    got = trie_join.join_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    want, _ = brute(docs)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({r[2] for r in want}) == 40
    assert sum(tried) <= 4


def test_bitmaps_never_part_what_links():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.choice([9, 20, 127, 128, 255, 256, 1000])
        a = [rng.getrandbits(63) - 2**62 for _ in range(n)]
        b = a[rng.randint(0, n // 19) :] + [2**62 + rng.getrandbits(60) for _ in range(rng.randint(0, n // 19))]
        sets = [trie_join.np.array(sorted(s), dtype="int64") for s in (a, b)]
        bits = [(int.from_bytes(trie_join.bitmap(s), "little"), 8 * len(trie_join.bitmap(s))) for s in sets]
        both = len({*a} & {*b})
        if 19 * both >= 9 * (len(a) + len(b)):
            assert trie_join.may_link(bits[0], len(a), bits[1], len(b)) and trie_join.may_link(bits[1], len(b), bits[0], len(a))

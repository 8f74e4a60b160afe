"""Conversation structure repair against a table of all edits, row by row, and against its SQL on odd conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from loomstar.llm import ORACLE_SQL, QUERIES, turn_repair

FITS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ONE = {0: 2, 1: 2, 2: 3, 3: 2}


def inserted(now):
    now = dict(now)
    for _ in range(3):
        for s, (c, a) in list(now.items()):
            now[ONE[s]] = min(now.get(ONE[s], (1 << 30, "")), (c + 3, a + "I"))
    return now


def cheapest(initials, faults, start=0, final=True):
    """Every edit of every row: the least (cost, audit) by last initial; or of the whole."""
    now = {start: (0, "")}
    for initial, fault in zip(initials, faults, strict=True):
        new = {}
        for s, (c, a) in inserted(now).items():
            options = [(s, c + 4, "D")]
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                options.append((ONE[s], c + 3 + more, "R"))
                if initial in FITS[s]:
                    options.append((FITS[s][initial], c + more, "K"))
            for t, cost, edit in options:
                new[t] = min(new.get(t, (1 << 30, "")), (cost, a + edit))
        now = new
    return min(v for s, v in inserted(now).items() if s in (0, 3)) if final else now


def odd_rows(rng, n):
    return [rng.choice("uuuaaas t") for _ in range(n)], [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]


def test_search_equals_the_table_of_all_edits():
    rng = random.Random(3)
    for _ in range(1500):
        initials, faults = odd_rows(rng, rng.randint(0, 14))
        assert turn_repair.search(initials, faults, 0, None) == cheapest(initials, faults)
        for start in range(4):
            want = cheapest(initials, faults, start, False)
            assert {e: got for e in range(4) if (got := turn_repair.search(initials, faults, start, e))} == want


def test_parts_give_what_the_whole_gives():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(2, 40)
        initials, faults = odd_rows(rng, n)
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6)))), n]
        parts = [turn_repair.solved(0, k == 0, False, [(i, initials[i], "x", faults[i]) for i in range(a, b)]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        chosen = turn_repair.choices([p["costs"] for p in parts], [p["ranks"] for p in parts])
        tail = turn_repair.TAILS[chosen[-1] % 4]
        got = sum(p["costs"][c] for p, c in zip(parts, chosen, strict=True)) + 3 * len(tail), "".join(p["audits"][c] for p, c in zip(parts, chosen, strict=True)) + tail
        assert got == cheapest(initials, faults)


def brute(rows):
    """The contract's rows from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        harm = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(harm, text)
        convs[conv_id] += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = {r[0] for r in own} - {None}
        cost, audit = cheapest(initials, faults)
        lines, state, i = [], 0, 0
        for edit in audit:
            if edit != "D":
                role, text = own[i][1:] if edit == "K" else ("assistant" if state == 2 else "user", own[i][2] if edit == "R" else "")
                state = FITS[state][role[0]]
                lines.append(f"{role}:{text}")
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_conversations():
    rng = random.Random(9)
    texts = ["Yes.", "no", "Why?", "", " \t", None, "A long one! ", "déjà vu.", "a.b", "...", "text with\nlines"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "udo"]), rng.choice(texts)) for c in range(150) for t in rng.sample(range(20), rng.randint(0, 9))]
    rows += [(None, t, "user", "w.") for t in range(5)] + [(200, None, r, "x.") for r in ("user", "assistant", None)] + [(201, 5, "user", "same turn."), (201, 5, "assistant", "same turn."), (201, 5, "user", "same turn.")]
    rows += [(300, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 700}{'.' if t % 5 else ''}") for t in range(4000)]  # a third of all rows and more, with repeats far apart
    rows += [(301, 7, "assistant", "the same in one turn.")] * 900 + [(302, 0, "user", "long. " * 50_000), (302, 1, "assistant", "yes " * 400_000)]
    return rows


def test_query_on_odd_and_hot_conversations(spark, tmp_path):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string, fault int, digest string")
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_turn_repair"](spark, str(tmp_path))
    key = lambda r: tuple(map(str, r))
    have, want = sorted(map(tuple, got.collect()), key=key), sorted(brute(rows), key=key)
    assert have == want
    assert {r[0] for r in have} >= {None, 200, 201, 300, 301, 302}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = c.execute(ORACLE_SQL["op11_turn_repair"])
    names = [x[0] for x in cur.description]
    assert sorted(cur.fetchall(), key=key) == sorted(map(tuple, got.select(*names).collect()), key=key)


def test_a_conversation_lies_in_several_parts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    parts = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(parts) >= 3000 // turn_repair.PART_ROWS and all(r["open"] for r in parts)
    assert "".join(r["audit"] for r in sorted(parts, key=lambda r: r["part"])) == "K" * 3000
    assert "\n".join(r["repaired"] for r in sorted(parts, key=lambda r: r["part"])) == "\n".join(f"{r[2]}:{r[3]}" for r in rows)


def test_every_row_dropped(spark, tmp_path):
    gone = [(c, t, "user", "x.") for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    spark.createDataFrame(gone, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert sorted(r["conv_id"] for r in got) == sorted({r[0] for r in gone})

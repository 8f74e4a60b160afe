"""Conversation structure repair: a depth-first branch-and-bound for the cheapest edits that give well-formed turns.

A conversation is well-formed if its roles' initials are (s?(ua)+)?: an optional system turn, then user and assistant in
turn. Edits of a row are Keep (0), Rerole to user or assistant (3) and Delete (4; blank rows and repeats of an earlier row must go);
an empty user or assistant row is Inserted anywhere for 3; a truncated row that isn't deleted adds 3. Of equally cheap audits
(the edits' initials in order) the ASCII-least is taken.

1. Faults are columns. A row's first occurrence is a least (turn, row) by conversation, role and text's digest,
   combined before the shuffle, and marked by a join on the row's own number.
2. The rows are dealt by ranges of (conversation, turn, ...), so that one conversation of any length lies in several tasks.
   Within a task it is cut into parts: at the ends of the task, and at PART_ROWS rows or PART_BYTES of texts.
3. search() solves a part: an explicit stack of prefixes, bounds() for what the suffix costs at least from a last initial, whatever
   its audit; the best (cost, audit) so far as the incumbent; and a table of the best prefix that has come to each node (rows
   read, last initial). A prefix goes if a better one has come to its node or if it can't be better than the incumbent; the search
   ends when none is left. A whole conversation, as nearly all are, is one search.
4. A part of a longer conversation is searched from each last initial before it to each at its end. Edits before a
   row belong to the row's part, so audits of one part and start never begin one another and the parts' choices are
   independent: settled() finds the last initials between the parts from numbers alone (16 costs and ranks a part), the
   cheapest from behind, then the ASCII-least from the front.

The audit and the hash of the text are one value of a conversation; the hash is fed part by part (text_sha256). settled()
holds about 300 bytes a part of one conversation.

Edge cases: a null role or text is one space (so the one can't be kept, the other is blank); a null conv_id is a conversation;
null turns come first; rows of one turn come by role, text's digest and row; repeated rows are duplicates; an empty
table has no conversations. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
PART_ROWS, PART_BYTES = 256, 1 << 20
#: Last initials: none, s, u, a. The state after an s, u or a; the one after the only user or assistant row that fits.
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEXT, ROLES = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
#: What remains to be inserted at the end of a conversation.
TAILS = ["", "II", "I", ""]
NEVER = math.inf
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \\t\\n\\u000B\\f\\r"


def bounds(initials: list[str], faults: list[int], rest: list[float]) -> list[list[float]]:
    """For each place and last initial before it, what the rows from there on cost at least: their cheapest edits whatever the audit; rest: of the end."""
    least = [[]] * len(initials) + [rest]
    for i in range(len(initials) - 1, -1, -1):
        behind = least[i + 1]
        own = [DELETE + cost for cost in behind]
        if faults[i] not in (BLANK, DUPLICATE):
            extra = TRUNCATED if faults[i] == CUT else 0
            for state in range(4):
                kept = behind[AFTER[state][initials[i]]] if initials[i] in AFTER[state] else NEVER
                own[state] = min(own[state], extra + kept, extra + REROLE + behind[NEXT[state]])
        least[i] = [min(own[s], INSERT + own[NEXT[s]], 2 * INSERT + own[NEXT[NEXT[s]]]) for s in range(4)]
    return least


def search(initials: list[str], faults: list[int], start: int, end: int | None) -> tuple[int, str] | None:
    """The cheapest and ASCII-least (cost, audit) that leads from one last initial to another, without an insert after the last row; None if none does.

    end None: that ends a conversation.
    """
    n = len(initials)
    least = bounds(initials, faults, [3.0 * len(t) for t in TAILS] if end is None else [0 if s == end else NEVER for s in range(4)])
    if least[0][start] == NEVER:
        return None
    incumbent: tuple[float, str] = (NEVER, "")
    best: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best[i, state] < (cost, audit):
            continue  # a better prefix has come to this node since
        atleast = cost + least[i][state]
        if atleast > incumbent[0] or atleast == incumbent[0] and audit > incumbent[1][: len(audit)]:
            continue
        if i == n and (state in (0, 3) if end is None else True):
            incumbent = min(incumbent, (cost, audit))
            continue
        steps = [(i, NEXT[state], cost + INSERT, audit + "I")]
        if i < n:
            steps.append((i + 1, state, cost + DELETE, audit + "D"))
            if faults[i] not in (BLANK, DUPLICATE):
                extra = cost + (TRUNCATED if faults[i] == CUT else 0)
                steps.append((i + 1, NEXT[state], extra + REROLE, audit + "R"))
                if initials[i] in AFTER[state]:
                    steps.append((i + 1, AFTER[state][initials[i]], extra, audit + "K"))
        for step in sorted(steps, key=lambda s: (s[2] + least[s[0]][s[1]], s[3]), reverse=True):
            node = step[0], step[1]
            if step[2] + least[step[0]][step[1]] <= incumbent[0] and (node not in best or step[2:] < best[node]):
                best[node] = step[2:]
                stack.append(step)
    return incumbent


def repaired_lines(roles: list[str], texts: list[str], start: int, audit: str) -> list[str]:
    """role:text of each row that the audit leaves or inserts."""
    lines, state, i = [], start, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = (roles[i], texts[i]) if edit == "K" else (ROLES[state], texts[i] if edit == "R" else "")
        state = AFTER[state][role[:1]]
        i += edit != "I"
        lines.append(f"{role}:{text}")
    return lines


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, row and fault (0 for none) of each row."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = common.written(rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("row", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("row").alias("row"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("_first"))
    core = F.expr(f"trim(BOTH '{SPACES}' FROM text)")
    fault = F.when(core == "", BLANK).when(F.col("_first").isNull(), DUPLICATE).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.join(first, "row", "left").select("conv_id", "turn", "role", "text", "digest", "row", fault.alias("fault"))


PART = "part long, open boolean, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, n_turns long, costs array<int>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>, repaired string"


def solved(part: int, opens: bool, closes: bool, rows: list[tuple]) -> dict:
    """A part of a conversation: its counts; if it is the whole of it, the repaired text, else costs, ranks and audits by start and end."""
    turns, roles, texts, faults = map(list, zip(*rows, strict=True))
    initials = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    out = {
        "part": part, "open": not (opens and closes), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "first_initial": initials[0], "last_initial": initials[-1],
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)),
        "roles": None, "texts": None, "ranks": None, "repaired": None,
    }
    if opens and closes:
        cost, audit = search(initials, faults, 0, None)
        return out | {"costs": [cost], "audits": [audit], "repaired": "\n".join(repaired_lines(roles, texts, 0, audit))}
    costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
    for start in range(1 if opens else 4):
        found = {end: got for end in range(4) if (got := search(initials, faults, start, end))}
        order = sorted(audit for _, audit in found.values())
        for end, (cost, audit) in found.items():
            at = 4 * start + end
            costs[at], ranks[at], audits[at] = cost, order.index(audit), audit
    return out | {"costs": costs, "ranks": ranks, "audits": audits, "roles": roles, "texts": texts}


def parts_of(rows: DataFrame) -> DataFrame:
    """The parts of all conversations, in ranges of tasks."""
    conv = next(f for f in rows.schema if f.name == "conv_id")
    order = ["conv_id", "turn", "role", "digest", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, opens = TaskContext.get().partitionId() << 33, [], 0, False
        out, was, schema = [], None, None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("conv_id"), *PART_FIELDS])
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (conv_id != was or len(held) >= PART_ROWS or size >= PART_BYTES):
                    closes = conv_id != was
                    out.append({"conv_id": was} | solved(number, opens, closes, held))
                    number, held, size, opens = number + 1, [], 0, closes
                was = conv_id
                held.append(tuple(row))
                size += len(row[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": was} | solved(number, opens, False, held)], schema)

    return dealt.mapInArrow(run, f"conv_id {conv.dataType.simpleString()}, {PART}")


def _field(name: str, kind: str) -> pa.Field:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.field(name, pa.list_(plain[kind[6:-1]]) if kind.startswith("array") else plain[kind])


PART_FIELDS = [_field(*x.split()) for x in PART.split(", ")]


def choices(costs: list[list], ranks: list[list]) -> list[int]:
    """For the parts of one conversation, in order: the place in costs (4 x start + end) that the cheapest, ASCII-least repair takes."""
    rest = [[3 * len(t) for t in TAILS]]
    for own in reversed(costs):
        rest.append([min((own[4 * s + e] + rest[-1][e] for e in range(4) if own[4 * s + e] is not None), default=1 << 60) for s in range(4)])
    rest.reverse()
    chosen, state = [], 0
    for k, (own, rank) in enumerate(zip(costs, ranks, strict=True)):
        ends = [e for e in range(4) if own[4 * state + e] is not None and own[4 * state + e] + rest[k + 1][e] == rest[k][state]]
        end = min(ends, key=lambda e: rank[4 * state + e])
        chosen.append(4 * state + end)
        state = end
    return chosen


def settled(parts: DataFrame) -> DataFrame:
    """Of each open part: its choice, whether it is the last, the illegal pair before it, and its first turn if that is also the last of the part before."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        chosen = choices(col["costs"], col["ranks"])
        before = [None, *col["last_initial"][:-1]]
        pairs = [int(a is not None and a + b not in ("su", "ua", "au")) for a, b in zip(before, col["first_initial"], strict=True)]
        again, last = [], None
        for a, b in zip(col["first_turn"], col["last_turn"], strict=True):
            again.append(int(a is not None and a == last))
            last = b if b is not None else last
        ends = [False] * (len(chosen) - 1) + [True]
        return pa.table({"part": table.column("part"), "choice": pa.array(chosen, pa.int32()), "ends": pa.array(ends, pa.bool_()), "pair": pa.array(pairs, pa.int64()), "again": pa.array(again, pa.int64())})

    light = parts.select("conv_id", "part", "costs", "ranks", "first_initial", "last_initial", "first_turn", "last_turn")
    return light.groupBy("conv_id").applyInArrow(run, "part long, choice int, ends boolean, pair long, again long")


def repair(turns: DataFrame) -> DataFrame:
    """The parts of each conversation in order of part: counts (their sums are the conversation's), cost, audit and repaired (role:text lines).

    Columns: conv_id, part, open (of a longer conversation), blank, duplicate, truncated, illegal, n_turns, first_turn, last_turn, cost, audit, repaired.
    """
    parts = common.written(parts_of(with_faults(turns)), "parts")
    same = ["conv_id", "part", "open", "blank", "duplicate", "truncated"]
    turn = ["first_turn", "last_turn"]
    whole = parts.where("not open").select(*same, "illegal", "n_turns", *turn, F.col("costs")[0].cast("long").alias("cost"), F.col("audits")[0].alias("audit"), "repaired")
    open_parts = parts.where("open")
    chosen = common.written(settled(open_parts), "choices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for roles, texts, start, audit in zip(*(b.column(c).to_pylist() for c in ("roles", "texts", "start", "audit")), strict=True):
                lines.append("\n".join(repaired_lines(roles, texts, start, audit)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 3)), pa.array(lines, pa.string())], [*b.schema.names[: b.num_columns - 3], "repaired"])

    tail = F.when(F.col("ends"), F.element_at(F.array(*map(F.lit, TAILS)), F.col("choice") % 4 + 1)).otherwise("")
    cost = F.get("costs", "choice").cast("long") + INSERT * F.length(tail)
    joined = open_parts.join(chosen, "part").select(*same, (F.col("illegal") + F.col("pair")).alias("illegal"), (F.col("n_turns") - F.col("again")).alias("n_turns"), *turn, cost.alias("cost"), F.concat(F.get("audits", "choice"), tail).alias("audit"), "roles", "texts", F.floor(F.col("choice") / 4).cast("int").alias("start"))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    rest = joined.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    return whole.unionByName(rest)


def text_sha256(parts: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the parts' repaired texts joined by newlines, fed part by part; for conversations of several parts."""
    kind = next(f for f in parts.schema if f.name == "conv_id").dataType.simpleString()
    dealt = parts.select("conv_id", "part", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, digest, fed = None, None, False
        schema = None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("conv_id"), ("repaired_sha256", pa.string())])
            done = []
            for conv_id, text in zip(b.column("conv_id").to_pylist(), b.column("repaired").to_pylist(), strict=True):
                if digest is None or conv_id != was:
                    if digest is not None:
                        done.append({"conv_id": was, "repaired_sha256": digest.hexdigest()})
                    was, digest, fed = conv_id, hashlib.sha256(), False
                if text:
                    digest.update((("\n" if fed else "") + text).encode("utf-8", "replace"))
                    fed = True
            yield pa.RecordBatch.from_pylist(done, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": was, "repaired_sha256": digest.hexdigest()}], schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def audits(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each of the ids (a column conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    parts = common.written(repair(turns), "repaired")
    gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    whole, several = parts.where("not open"), parts.where("open")
    light = several.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *sums, joined.alias("audit"))
    hashed = text_sha256(several)
    light = light.join(hashed.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    found = whole.select("conv_id", own.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256")).unionByName(light)
    found = found.withColumnRenamed("conv_id", "_conv")
    out = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text where crc32 of conv_id:turn, modulo 20, drops a row (0), empties its text (1), takes its ends of sentences (2), repeats it (3) or gives it to the user (4)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    harm = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), harm.alias("_harm")).where("_harm <> 0")
    rows = rows.withColumn("text", F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_harm") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")

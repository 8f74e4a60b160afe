"""Large files in order: lines and JSON elements of files that many splits cut, against Python's readers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstar.operators import simple
from loomstar.sources import ordered_text, sinks, transcripts


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "1")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_lines_have_pythons_numbers_in_any_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(1)
    for name in ("a", "b"):
        text = "".join(rng.choice(["", "x", "é" * 40, "  ", '{"type":"user"}', "long " * 60]) + rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(300))
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    rows = ordered_text.pieces(spark, str(tmp_path), files="*.jsonl")
    assert rows.select("path", "split").distinct().count() > 40
    got = {}
    for r in rows.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["piece"]] = r["value"]
    for name in ("a.jsonl", "b.jsonl"):
        with open(tmp_path / name, encoding="utf-8") as f:
            assert got[name] == dict(enumerate(x.rstrip("\n") for x in f))


def test_json_elements_in_any_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    odd = ['}"', "{[", "\\", '\\"', "]", "é}", "", "a,b", "\n{", '\\\\"}']

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return rng.choice([*odd, 1, 2.5, None, True])
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind < 0.7 else {rng.choice([*odd, "k"]) + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}

    want = {"a": [{"i": i, "v": value(0)} for i in range(150)], "b": [], "c": [{}], "d": [{"x" * 700: "}" * 900}, {}]}
    for name, items in want.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(items, ensure_ascii=False, indent=rng.choice([None, 2])), encoding="utf-8")
    got = {name: [] for name in want}
    for r in ordered_text.json_elements(spark, str(tmp_path)).orderBy("path", "nth").collect():
        got[r["path"].rsplit("/", 1)[1][0]].append(json.loads(r["element"]))
    assert got == want


def test_export_keeps_inputs_and_the_order_of_its_file(spark, tmp_path):
    call = {"type": "tool_use", "name": "Run", "input": {"n": 1, "a": {"b": [2, 3]}, "t": True, "none": None}}
    message = lambda u, sender, *content: {"uuid": u, "sender": sender, "created_at": "2025-01-01T00:00:00Z", "text": "", "content": list(content)}
    think = {"type": "thinking", "thinking": "hm"}
    made = {"type": "tool_result", "tool_use_id": "tool_z_m1", "content": {"k": [None]}}
    talks = [
        {"uuid": "z", "name": "first", "chat_messages": [message("m1", "assistant", think, call, {**call, "id": "", "input": "te}xt"})]},
        {"uuid": "a", "name": "second", "chat_messages": [message("m2", "human", made), message("m3", "assistant", think, {**call, "id": "i", "input": None}), message("m6", "human", {"type": "tool_result", "tool_use_id": "i", "content": "ok"})]},
        {"uuid": "z", "name": "again", "chat_messages": [message("m4", "human", {"type": "tool_result", "tool_use_id": "i", "content": "too early, as z is first"}), message("m5", "assistant", think)]},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(talks))
    t = simple.from_account_export(spark, str(tmp_path))
    calls = {r["tool_use_id"]: (r["session_id"], r["input_json"], r["result_text"]) for r in t["tool_calls"].collect()}
    assert calls == {"tool_z_m1": ("z", '"te}xt"', "{'k': [None]}"), "i": ("a", "null", "ok")}
    assert [(r["id"], r["message_id"]) for r in t["thinking"].orderBy("id").collect()] == [(1, "m1"), (2, "m5"), (3, "m3")]
    entries = transcripts.account_export(spark, str(tmp_path))["entries"]
    assert sorted((r["session_id"], r["line_no"], r["uuid"]) for r in entries.collect()) == [("a", 0, "m2"), ("a", 1, "m3"), ("a", 2, "m6"), ("z", 0, "m1"), ("z", 1, "m4"), ("z", 2, "m5")]
    first = json.loads(entries.where("uuid = 'm1'").first()["content"])
    assert first[1] == {"type": "tool_use", "id": "tool_z_m1", "name": "Run", "input": call["input"]}


def test_document_of_several_and_empty_tables(spark, tmp_path):
    tables = {"a": spark.range(3).select("id", F.lit(None).cast("string").alias("none")), "b": spark.range(0), "c": spark.createDataFrame([('q"}',)], "t string")}
    sinks.write_document(spark, tables, str(tmp_path / "x/doc.json"))
    doc = json.loads((tmp_path / "x/doc.json").read_text())
    assert doc["schema_type"] == "simple" and doc["tables"] == {"a": [{"id": i, "none": None} for i in range(3)], "b": [], "c": [{"t": 'q"}'}]}
    sinks.write_document(spark, {"b": spark.range(1)}, str(tmp_path / "x/doc.json"))
    assert json.loads((tmp_path / "x/doc.json").read_text())["tables"] == {"b": [{"id": 0}]}
    sinks.write_json_array(spark, spark.createDataFrame([(2, '{"b":2}'), (1, '{"a":1}')], "n int, j string"), ["n"], "j", str(tmp_path / "array.json"))
    assert json.loads((tmp_path / "array.json").read_text()) == [{"a": 1}, {"b": 2}]

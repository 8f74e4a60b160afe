"""Transcripts by hand through readers, star and simple schemas, links and conversations."""

import json

import pytest
from pyspark.sql import functions as F

from loomstar.functions import columns as C
from loomstar.operators import conversation, inspection, links, simple
from loomstar.operators.star import DIMENSIONS, FACTS, Star
from loomstar.sources import sinks, transcripts
from tests import fixtures as X


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    X.write(root / "-home-u-projects-app", "basic.jsonl", X.BASIC, ["", "{broken", "   ", json.dumps({"type": "file-history-snapshot"})])
    X.write(root / "-home-u-projects-app", "chain.jsonl", X.CHAIN)
    X.write(root / "odd one", "odd.jsonl", X.ODD)
    X.write(root / "odd one", "broken.jsonl", X.BROKEN)
    X.write(root / "odd one", "agent-1.jsonl", [X.entry("user", "g1", None, X.at(3), "hi", agentId="1", isSidechain=True, sessionId="basic")])
    return str(root)


@pytest.fixture(scope="module")
def entries(spark, folder):
    return links.cut(transcripts.read_entries(spark, folder), "entries")


@pytest.fixture(scope="module")
def star(entries):
    return Star(entries)


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def key(x):
    import hashlib

    return hashlib.md5(x.encode()).hexdigest()


def test_entries(entries, folder):
    basic = rows(entries.where("session_id = 'basic'"), "line_no")
    assert [r["line_no"] for r in basic] == [0, 4, 5, 6, 7, 8, 9] and {r["content_kind"] for r in basic if r["has_message"]} == {"string", "array"}
    assert basic[0]["project_path"].endswith("/-home-u-projects-app")
    assert {r["session_id"] for r in transcripts.broken_sessions(entries).collect()} == {"broken"}
    odd = rows(entries.where("session_id = 'odd'"), "line_no")
    assert odd[1]["project_path"].endswith("/odd one") and odd[3]["ts"] is None
    assert str(odd[1]["ts"]) == "2025-02-28 19:00:30"


def test_session_summary_of_the_basic_session(star):
    r = rows(star.fact_session_summary.where(F.col("session_key") == key("basic")), "session_key")[0]
    assert (r["total_messages"], r["user_messages"], r["assistant_messages"], r["total_tool_calls"], r["session_duration_seconds"], r["total_thinking_blocks"], r["total_content_blocks"]) == (6, 3, 3, 2, 25, 1, 9)
    assert r["date_key"] == 20250115


def test_messages(star):
    by = {(r["session_key"], r["message_id"], r["content_length"]): r for r in rows(star.fact_messages, "message_id")}
    one = next(r for k, r in by.items() if k[1] == "asst-001")
    assert one["response_time_seconds"] == 5.0 and one["has_tool_use"] and not one["has_thinking"] and one["conversation_depth"] == 1 and one["word_count"] == 4
    assert one["content_block_count"] == 2 and one["estimated_tokens"] == 5 and one["time_key"] == 1000
    deep = {r["message_id"]: r["conversation_depth"] for r in by.values()}
    assert deep["asst-003"] == 5 and deep["a5"] == 9
    assert deep["x2"] == 0 and deep["x3"] == 1  # the parent of x2 comes later in the file
    again = [r for r in by.values() if r["message_id"] == "x1"]
    assert sorted(r["conversation_depth"] for r in again) == [0, 3]
    assert next(r for r in by.values() if r["message_id"] == "x4")["conversation_depth"] == 4  # below the later row of x1
    odd = next(r for r in again if r["content_length"] == 14)
    assert (odd["date_key"], odd["time_key"]) == (20250301, 0)  # as written, not in UTC
    assert next(r for r in by.values() if r["message_id"] == "x3")["response_time_seconds"] is None
    assert len(next(r for r in by.values() if r["message_id"] == "x9")["content_text"]) == 2000
    assert "b1" not in deep


def test_tool_calls(star):
    calls = rows(star.fact_tool_calls, "tool_call_id", "output_text")
    by = {(r["tool_call_id"], r["output_text"]): r for r in calls}
    assert set(by) == {("t1", "File written"), ("t2", "a b"), ("c1", "def login(): pass"), ("c2", "OSError: failed"), ("c3", "[main abc1234] Add login\nrest"), ("c4", "2 matches"), ("d1", "one"), ("d1", "two")}
    r = by["t1", "File written"]
    assert (r["invoke_message_id"], r["result_message_id"], r["output_char_count"], r["is_error"]) == ("asst-001", "user-002", 12, False)
    assert r["input_json"] == json.dumps({"file_path": "/home/u/app/hello.py", "content": "print(1)"}) and r["input_char_count"] == len(r["input_json"])
    assert by["c2", "OSError: failed"]["input_json"] == json.dumps({"command": "pytest é"})
    assert [(r["error_id"], r["tool_key"]) for r in rows(star.fact_errors, "error_id")] == [("c2-error", key("Bash"))]


def test_tool_chain(star):
    steps = rows(star.fact_tool_chain_steps.where(F.col("session_key") == key("chain")), "step_position")
    assert [r["tool_key"] for r in steps] == [key(t) for t in ("Read", "Bash", "Edit", "Grep")]
    assert [r["prev_tool_key"] for r in steps] == [None, key("Read"), key("Bash"), key("Edit")]
    assert [r["time_since_prev_seconds"] for r in steps] == [None, 15.0, 20.0, 10.0]
    assert steps[2]["chain_step_id"] == f"{key('chain')}-chain-2"


def test_files(star):
    files = {r["file_path"]: r for r in rows(star.dim_file, "file_path")}
    assert set(files) == {"/home/u/app/hello.py", "/src/auth.py", "/src", "/a/.bashrc"}
    assert (files["/src/auth.py"]["file_name"], files["/src/auth.py"]["file_extension"], files["/src/auth.py"]["directory_path"]) == ("auth.py", ".py", "/src")
    assert files["/a/.bashrc"]["file_extension"] == "" and files["/src"]["directory_path"] == "/"
    kinds = {r["tool_call_id"]: (r["operation_type"], r["file_size_chars"]) for r in rows(star.fact_file_operations, "tool_call_id")}
    assert kinds == {"t1": ("write", 8), "t2": ("read", 0), "c1": ("read", 0), "c3": ("edit", 0), "c4": ("search", 0), "d2": ("read", 0)}


def test_blocks_and_code(star):
    blocks = rows(star.fact_content_blocks.where("message_id = 'asst-002'"), "block_index")
    assert [r["content_block_type_key"] for r in blocks] == [key("thinking"), key("text"), key("tool_use")]
    odd = rows(star.fact_content_blocks.where("message_id = 'x2'"), "block_index")
    assert [(r["block_index"], r["content_text"]) for r in odd][1] == (2, "[image]") and len(odd) == 2
    code = rows(star.fact_code_blocks, "block_index")
    assert [(r["code_block_id"], r["language_key"], r["line_count"]) for r in code] == [("a3-code-0", key("python"), 3), ("a3-code-1", key("unknown"), 2)]
    hidden = Star(star.entries, thinking=False)
    assert hidden.fact_content_blocks.where("message_id = 'asst-002'").count() == 2
    s = rows(hidden.fact_session_summary.where(F.col("session_key") == key("basic")), "session_key")[0]
    assert (s["total_thinking_blocks"], s["total_content_blocks"]) == (1, 8)


def test_entities(star):
    found = {(r["entity_type_key"], r["entity_text"]) for r in rows(star.fact_entity_mentions.where(F.col("session_key") == key("chain")), "position_start")}
    names = {key(k): k for k in ("file_path", "url", "function_name", "error_code", "git_ref")}
    assert {(names[k], t) for k, t in found} == {("file_path", "/src/auth.py"), ("git_ref", "main"), ("function_name", "login"), ("function_name", "helper"), ("file_path", "./lib/util.js"), ("url", "https://example.org/a,"), ("error_code", "OSError")}
    r = star.fact_entity_mentions.where("entity_text = 'OSError'").first()
    full = X.CHAIN[-1]["message"]["content"]
    assert full[r["position_start"] : r["position_end"]] == "OSError" and r["context_snippet"].endswith("OSError") and r["mention_id"] == key(f"a5|error_code|{full.index('OSError')}")


def test_dimensions(star):
    session = {r["session_id"]: r for r in rows(star.dim_session, "session_id")}
    assert set(session) == {"basic", "chain", "odd", "agent-1"}
    assert session["agent-1"]["is_agent"] and session["agent-1"]["parent_session_key"] == key("basic") and session["basic"]["parent_session_key"] is None
    assert session["basic"]["cwd"] == "/home/u/app" and session["chain"]["git_branch"] == "feature/auth"
    assert {(r["model_name"], r["model_family"]) for r in rows(star.dim_model, "model_name")} == {("m-opus-4", "opus"), ("m-sonnet-4", "sonnet")}
    assert {r["tool_name"]: r["tool_category"] for r in rows(star.dim_tool, "tool_name")} == {"Write": "file_operations", "Read": "file_operations", "Edit": "file_operations", "Bash": "execution", "Grep": "search", "Weird": "other"}
    times = {r["time_key"]: r["time_of_day"] for r in rows(star.dim_time, "time_key")}
    assert times == {0: "night", 1000: "morning", 1400: "afternoon"}
    day = {r["date_key"]: r for r in rows(star.dim_date, "date_key")}[20250115]
    assert (day["day_name"], day["month_name"], day["day_of_week"], day["quarter"], day["is_weekend"]) == ("Wednesday", "January", 2, 1, False)


def test_all_tables_and_views(star):
    tables = star.tables()
    assert set(tables) == {*DIMENSIONS, *FACTS, "stg_raw_messages"}
    assert [tables[t].count() for t in ("dim_intent", "dim_topic", "dim_sentiment", "dim_entity_type", "dim_message_type", "dim_content_block_type")] == [10, 10, 7, 8, 2, 5]
    views = star.views()
    assert views["semantic_sessions"].count() == 4 and views["semantic_tool_calls"].where("tool_name = 'Write'").first()["time_of_day"] == "morning"
    assert views["semantic_messages"].where("model_family = 'opus'").count() == 2 and views["semantic_file_operations"].where("file_name = 'auth.py'").count() == 2


def test_result_does_not_depend_on_partitions(spark, entries):
    want = None
    for n in (1, 4, 16):
        got = sorted(map(str, Star(entries.repartition(n)).fact_messages.collect()))
        want = want or got
        assert got == want


def test_simple_schema(entries):
    t = simple.simple_tables(entries, include_thinking=True)
    assert len(t["sessions"].columns) == 16 and len(t["messages"].columns) == 12 and len(t["tool_calls"].columns) == 9 and len(t["thinking"].columns) == 5
    s = {r["session_id"]: r for r in rows(t["sessions"], "session_id")}
    assert (s["basic"]["message_count"], s["basic"]["tool_use_count"], s["odd"]["tool_use_count"]) == (6, 2, 2)
    assert t["messages"].where("content like '%hello%'").count() == 1
    calls = rows(t["tool_calls"], "tool_use_id", "result_text")
    assert [c["tool_use_id"] for c in calls] == ["c1", "c2", "c3", "c4", "d1", "d1", "t1", "t2"]
    open_too = simple.simple_tables(entries, unresolved=True)
    assert open_too["tool_calls"].where("tool_use_id = 'd2' and result_text is null").count() == 1 and open_too["thinking"].count() == 0


def test_account_export(spark, tmp_path):
    chat = [
        {"uuid": "m1", "text": "Hi", "sender": "human", "created_at": X.at(0), "content": [X.text("Hi")]},
        {"uuid": "m2", "text": "", "sender": "assistant", "created_at": X.at(4), "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": None, "name": "Find", "input": {"q": "x"}}]},
        {"uuid": "m3", "text": "", "sender": "human", "created_at": X.at(6), "content": [X.result("tool_k1_m2", "found")]},
        {"uuid": "m4", "text": "plain", "sender": "assistant", "created_at": X.at(9), "content": []},
    ]
    data = [{"uuid": "k1", "name": "First", "summary": "", "created_at": X.at(0), "updated_at": X.at(9), "chat_messages": chat}, {"uuid": "k2", "name": "Empty", "chat_messages": []}]
    with pytest.raises(FileNotFoundError):
        transcripts.account_export(spark, str(tmp_path))
    (tmp_path / "conversations.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "users.json").write_text(json.dumps([{"uuid": "u", "full_name": "N"}]))
    got = transcripts.account_export(spark, str(tmp_path))
    assert set(got) == {"entries", "users"} and got["users"].first()["full_name"] == "N"
    assert [(r["type"], r["content_kind"]) for r in rows(got["entries"], "line_no")] == [("user", "array"), ("assistant", "array"), ("user", "array"), ("assistant", "string")]
    t = simple.from_account_export(spark, str(tmp_path))
    assert [(r["tool_name"], r["result_text"]) for r in t["tool_calls"].collect()] == [("Find", "found")] and t["thinking"].count() == 1
    assert transcripts.account_export(spark, str(tmp_path), ["k2"])["entries"].count() == 0
    assert transcripts.account_export(spark, str(tmp_path), None, False)["entries"].where("content like '%thinking%'").count() == 0


def test_discovery(spark, folder, entries):
    blocks = transcripts.blocks(entries)
    said = transcripts.session_summaries(entries, blocks)
    by = {r["session_id"]: r["summary"] for r in said.collect()}
    assert by["basic"] == "Write a hello function" and by["odd"].endswith("...") and len(by["odd"]) == 200
    files = transcripts.session_files(spark, folder)
    found = transcripts.find_sessions(files, said)
    assert {r["session_id"] for r in found.collect()} == {"basic", "chain", "odd", "broken"}
    assert {r["session_id"] for r in transcripts.find_sessions(files, said, True, "APP").collect()} == {"basic", "chain"}
    assert {r["project"]: r["n"] for r in transcripts.projects(found).collect()} == {"-home-u-projects-app": 2, "odd one": 2}
    assert [(r["slug"], r["n_sessions"]) for r in transcripts.chains(files, entries, said).collect()] == [("odd-slug", 1)]


def test_document_form(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"loglines": X.BASIC}))
    got = transcripts.read_document(spark, str(tmp_path / "one.json"))
    assert got.count() == 6 and Star(got).fact_tool_calls.count() == 2
    X.write(tmp_path, "two.jsonl", X.BASIC)
    by = {p: transcripts.read_session(spark, str(tmp_path / p)) for p in ("one.json", "two.jsonl")}
    assert [r["uuid"] for r in by["one.json"].orderBy("line_no").collect()] == [r["uuid"] for r in by["two.jsonl"].orderBy("line_no").collect()]


def test_marks_of_contents(spark):
    texts = [' {"a": 1}\n', "[1]", "{broken", "plain", "", None, "[main 1] x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.is_json_like(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]
    result, text = '{"type":"tool_result","content":"x"}', '{"type":"text","text":"x"}'
    contents = [f"[{result}]", f"[{result},{result}]", f"[{result},{text}]", f'[{result},"s"]', "[]", "plain", None, "[{}]"]
    got = spark.createDataFrame([(t,) for t in contents], "t string").select(C.is_tool_result_message(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False, False]


def test_conversations(entries):
    blocks = transcripts.blocks(entries)
    texts = transcripts.message_texts(transcripts.messages_only(entries), blocks)
    seg = conversation.segments(texts)
    assert {(r["session_id"], r["line_no"]): r["conversation"] for r in seg.collect()}["chain", 9] == 1
    assert seg.where("session_id = 'odd'").agg(F.max("conversation")).first()[0] == 2
    assert conversation.prompt_numbers(seg).where("session_id = 'odd'").agg(F.max("prompt")).first()[0] == 1
    one = conversation.analysis(seg, blocks).where("session_id = 'chain'").first()
    assert one["tool_stats"] == "1 bash . 1 edit . 1 grep . 1 read" and [(c["hash"], c["message"]) for c in one["commits"]] == [("abc1234", "Add login")]
    line = rows(conversation.timeline(seg, blocks).where("session_id = 'chain'"), "ts_text")
    assert [(r["kind"], r["content"]) for r in line] == [("prompt", "Look at the /src/auth.py file on branch main"), ("commit", "abc1234 Add login")]
    docs = conversation.search_documents(entries, blocks)
    kinds = {r["type"]: r["n"] for r in docs.where("session_id = 'chain'").groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"user": 1, "assistant": 1, "tool_use": 4, "tool_result": 4}  # one of them is a string that begins with a bracket
    assert [r["session_id"] for r in conversation.search(docs, "HELLO write").where("type = 'user'").collect()] == ["basic"]
    assert docs.where("session_id = 'basic' and type = 'tool_use'").first()["anchor"] == "msg-2025-01-15T10-00-05Z"


def test_closure(spark):
    edges = spark.createDataFrame([("a1", "s"), ("a2", "a1"), ("a3", "a2"), ("b", "t"), ("x", "y"), ("y", "x")], "child string, parent string")
    roots = spark.createDataFrame([("s",)], "id string")
    assert {tuple(r) for r in links.closure(edges, roots).collect()} == {("a1", "s"), ("a2", "s"), ("a3", "s")}
    assert {tuple(r) for r in links.closure(edges, roots, False).collect()} == {("a1", "s")}
    assert {tuple(r) for r in links.closure(edges, spark.createDataFrame([("x",)], "id string")).collect()} == {("y", "x"), ("x", "x")}


def test_deep_chain(spark):
    n = 700
    rows_ = spark.createDataFrame([("s", i, f"m{i}", f"m{i - 1}" if i else None) for i in range(n)], "g string, o int, n string, p string")
    assert links.depths(rows_, "g", "o", "n", "p").where("conversation_depth = o").count() == n


def test_depths_of_random_trees(spark):
    """Branches, repeated and unknown ids, parents that come later: against going up row by row."""
    import random

    rng, rows_, want = random.Random(4), [], {}
    for g in range(6):
        latest: dict[str, int] = {}
        for i in range(80):
            node = f"m{rng.randrange(50)}" if g % 2 else f"m{i}"
            parent = rng.choice([None, "", "none", f"m{rng.randrange(60)}", f"m{max(0, i - 1)}", f"m{max(0, i - 1)}", f"m{max(0, i - 2)}"])
            order = i * 3
            want[f"g{g}", order] = want[f"g{g}", latest[parent]] + 1 if parent in latest else 0
            latest[node] = order
            rows_.append((f"g{g}", order, node, parent))
    df = spark.createDataFrame(rows_, "g string, o int, n string, p string").repartition(7)
    assert {(r["g"], r["o"]): r["conversation_depth"] for r in links.depths(df, "g", "o", "n", "p").collect()} == want
    assert max(want.values()) > 5


def test_column_functions(spark):
    df = spark.createDataFrame([("-home-u-projects-my-app", "a\x1cb c"), ("-Users-u-code-src-x", ""), ("plain", None), ("-home-u", "def f"), ("", " ")], "f string, t string")
    got = df.select(C.project_display_name(F.col("f")).alias("p"), C.word_count(F.col("t")).alias("w"), C.estimated_tokens(F.coalesce("t", F.lit(""))).alias("e")).collect()
    assert [tuple(r) for r in got] == [("my-app", 3, 3), ("x", 0, 0), ("plain", 0, 0), ("u", 2, 3), ("", 0, 0)]
    paths = spark.createDataFrame([("/a/b.tar.gz",), ("x.py",), ("/d/Dockerfile",), ("/q/",), ("y.",)], "p string")
    got = paths.select(C.file_name(F.col("p")), C.file_extension(F.col("p")), C.directory_path(F.col("p")), C.language_of_extension(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("b.tar.gz", ".gz", "/a", "unknown"), ("x.py", ".py", ".", "python"), ("Dockerfile", "", "/d", "dockerfile"), ("q", "", "/", "unknown"), ("y.", "", ".", "unknown")]
    s = spark.createDataFrame([("x" * 150 + "Needle" + "y" * 150,)], "t string").select(C.snippet(F.col("t"), F.lit("needle")).alias("a"), C.snippet(F.col("t")).alias("b")).first()
    assert s["a"].startswith("...") and s["a"].endswith("...") and "Needle" in s["a"] and len(s["a"]) == 206 and s["b"] == "x" * 150 + "Needle" + "y" * 44 + "..."
    kinds = ["0b8c7d7e-1111-2222-3333-444455556666", "2025-01-01T10:00:00Z", "2025-01-01", "true", "https://a.b", "a@b.co", "some_enum", "Some text"]
    got = spark.createDataFrame([(k,) for k in kinds], "v string").select(C.string_format(F.col("v"))).collect()
    assert [r[0] for r in got] == ["uuid", "iso8601", "date", "boolean_string", "url", "email", "enum_like", None]


def test_inspection(spark, tmp_path):
    docs = spark.createDataFrame([('{"a": 1, "b": ["x_y", "z"], "c": null}',), ('{"a": 1.5, "b": []}',), ("{bad",)], "j string")
    got = {(r["path"], r["kind"]): r for r in inspection.profile(docs, "j").collect()}
    assert set(got) == {("$", "object"), ("$.a", "integer"), ("$.a", "number"), ("$.b", "array"), ("$.b[]", "string"), ("$.c", "null")}
    assert got["$.b[]", "string"]["enum_values"] == ["x_y", "z"] and got["$.b[]", "string"]["formats"] == {"enum_like": 2} and got["$.b", "array"]["documents"] == 2
    (tmp_path / "a.json").write_text('{"k": "v"}')
    (tmp_path / "b.json").write_text('[1]')
    assert {(r["file"], r["path"]) for r in inspection.inspect_folder(spark, str(tmp_path)).collect()} == {("a.json", "$"), ("a.json", "$.k"), ("b.json", "$"), ("b.json", "$[]")}


def test_sinks(spark, folder, tmp_path):
    done = sinks.archive(spark, folder, str(tmp_path / "star"))
    assert done["failed_sessions"] == ["broken"] and done["tables"]["fact_tool_calls"] == 8 and done["tables"]["dim_session"] == 3
    again = sinks.archive(spark, folder, str(tmp_path / "star"))
    assert again == done  # a second run adds nothing
    assert sinks.archive(spark, folder, str(tmp_path / "simple"), "simple", include_agents=True)["tables"]["sessions"] == 4
    assert [sinks.resolve_format(x) for x in ("duckdb", "duckdb-star", "json-star")] == [("simple", "duckdb"), ("star", "duckdb"), ("star", "json")] and sinks.resolve_format("json-star", "simple") == ("simple", "json")
    tables = {n: spark.read.parquet(str(tmp_path / "star" / n)) for n in ("dim_tool", "fact_tool_calls")}
    sinks.write_json(spark, tables, str(tmp_path / "json"), "star")
    meta = json.loads(spark.read.json(str(tmp_path / "json/meta")).first()["value"])
    assert meta["row_counts"] == {"dim_tool": 6, "fact_tool_calls": 8} and meta["relationships"][0]["to_table"] == "dim_tool"
    stats = sinks.statistics(spark, str(tmp_path / "star"), done["tables"], 2.0)
    assert (stats["sessions"], stats["rate"], stats["rows"]) == (3, 1.5, sum(done["tables"][t] for t in ("fact_messages", "fact_tool_calls", "fact_content_blocks", "fact_session_summary"))) and stats["size_mb"] > 0
    entries = transcripts.read_entries(spark, folder)
    docs = conversation.search_documents(entries, transcripts.blocks(entries))
    assert sinks.write_search_index(spark, docs, str(tmp_path / "index")) == docs.count() == spark.read.json(str(tmp_path / "index/documents")).count()
    assert spark.read.json(str(tmp_path / "index/version")).first()["version"] == 1
    part = tables["fact_tool_calls"]
    for _ in range(2):
        sinks.append_sessions(part, str(tmp_path / "kept"))
    sinks.append_sessions(part.where(F.col("session_key") == key("odd")).limit(1), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 7


def test_results_by_their_json_type(spark):
    """A result is told by its JSON type, never by its first character; lines may be indented by any white space."""
    results = {"a": '"[1, 2, 3]"', "b": '"[]"', "c": '"[main abc1234] Fix it"', "d": '{"z":1,"a":[true,null]}', "e": "12.5", "f": "null", "g": '[{"text":"x"},{"text":null},{"no":1},"bare"]', "h": '[{"text":"p"},{"text":"q"}]', "i": '""', "j": "[]"}
    want = {"a": "[1, 2, 3]", "b": "[]", "c": "[main abc1234] Fix it", "d": "{'z': 1, 'a': [True, None]}", "e": "12.5", "f": "None", "g": "x None ", "h": "p q", "i": "", "j": ""}
    lines = []
    for i, (k, value) in enumerate(results.items()):
        lines.append(f'\t {{"type":"assistant","uuid":"u{k}","timestamp":"2025-01-01T00:00:{i:02d}Z","message":{{"content":[{{"type":"tool_use","id":"{k}","name":"Bash","input":{{}}}}]}}}}\x1c ')
        lines.append(f'{{"type":"user","uuid":"r{k}","timestamp":"2025-01-01T00:01:{i:02d}Z","message":{{"content":[{{"type":"tool_result","tool_use_id":"{k}","content":{value}}}]}}}}')
    df = spark.createDataFrame([("s", "/p", i, x) for i, x in enumerate(lines)], "session_id string, project_path string, line_no int, line string").withColumn("line", C.strip(F.col("line")))
    entries = transcripts.parse_lines(df)
    got = {r["tool_call_id"]: (r["output_text"], r["output_char_count"]) for r in Star(entries).table("fact_tool_calls").collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    docs = conversation.search_documents(entries, transcripts.blocks(entries)).where("type = 'tool_result'")
    assert sorted(r["content"] for r in docs.collect()) == ["[1, 2, 3]", "[]", "[main abc1234] Fix it"]


def test_contents_by_their_json_type(spark):
    contents = {'"[1]"': "string", '"{}"': "string", '"12"': "string", '"true"': "string", "[]": "array", '[{"type":"text","text":"x"}]': "array", '{"a":1}': "other", "12": "other", "true": "other", "null": "other", '"two words"': "string"}
    df = spark.createDataFrame([("s", "/p", i, f'{{"type":"user","message":{{"content":{c}}}}}') for i, c in enumerate(contents)], "session_id string, project_path string, line_no int, line string")
    assert [r["content_kind"] for r in transcripts.parse_lines(df).orderBy("line_no").collect()] == list(contents.values())

"""Transcripts made by hand."""

import json


def entry(kind, uuid, parent, ts, content, model=None, **more):
    message = {"role": kind, "content": content} | ({"model": model} if model else {})
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "timestamp": ts, "message": message, **more}


def text(x):
    return {"type": "text", "text": x}


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, error=None):
    return {"type": "tool_result", "tool_use_id": i, "content": content} | ({} if error is None else {"is_error": error})


def at(seconds, day="2025-01-15", hour=10):
    return f"{day}T{hour:02d}:{seconds // 60:02d}:{seconds % 60:02d}Z"


BASIC = [
    entry("user", "user-001", None, at(0), "Write a hello function", cwd="/home/u/app", gitBranch="main", version="2.0", sessionId="other"),
    entry("assistant", "asst-001", "user-001", at(5), [text("I will write it."), use("t1", "Write", file_path="/home/u/app/hello.py", content="print(1)")], "m-opus-4"),
    entry("user", "user-002", "asst-001", at(10), [result("t1", "File written")]),
    entry("assistant", "asst-002", "user-002", at(15), [{"type": "thinking", "thinking": "Let me look."}, text("Now I read."), use("t2", "Read", file_path="/home/u/app/hello.py")], "m-opus-4"),
    entry("user", "user-003", "asst-002", at(20), [result("t2", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}])]),
    entry("assistant", "asst-003", "user-003", at(25), [text("Done.")], "m-sonnet-4"),
]
CHAIN = [
    entry("user", "u1", None, at(0, "2025-01-20", 14), "Look at the /src/auth.py file on branch main", cwd="/p", gitBranch="feature/auth"),
    entry("assistant", "a1", "u1", at(5, "2025-01-20", 14), [use("c1", "Read", file_path="/src/auth.py")], "m-sonnet-4"),
    entry("user", "u2", "a1", at(10, "2025-01-20", 14), [result("c1", "def login(): pass")]),
    entry("assistant", "a2", "u2", at(20, "2025-01-20", 14), [use("c2", "Bash", command="pytest é")], "m-sonnet-4"),
    entry("user", "u3", "a2", at(30, "2025-01-20", 14), [result("c2", "OSError: failed", True)]),
    entry("assistant", "a3", "u3", at(40, "2025-01-20", 14), [text("Fix:\n```python\ndef login():\n    return 1\n```\nand\n```\nplain\n```"), use("c3", "Edit", file_path="/src/auth.py")], "m-sonnet-4"),
    entry("user", "u4", "a3", at(45, "2025-01-20", 14), [result("c3", "[main abc1234] Add login\nrest")]),
    entry("assistant", "a4", "u4", at(50, "2025-01-20", 14), [use("c4", "Grep", path="/src")], "m-sonnet-4"),
    entry("user", "u5", "a4", at(55, "2025-01-20", 14), [result("c4", "2 matches")]),
    entry("assistant", "a5", "u5", at(59, "2025-01-20", 14), "See def helper(x) in ./lib/util.js and https://example.org/a, ValueError, OSError"),
]
ODD = [
    {"type": "summary", "summary": "A " * 150},
    entry("user", "x1", None, "2025-03-01T00:00:30+05:00", "midnight there", slug="odd-slug"),
    entry("assistant", "x2", "x9", at(5, "2025-03-01"), [use("d1", "Weird", file_path=None, path="/never"), "a bare string", {"type": "image", "source": {}}, {"type": "novel", "x": 1}]),
    entry("user", "x3", "x2", "not a time", [result("d1", "one"), result("d1", "two"), result("zz", "lost")], isMeta=True),
    entry("assistant", "x9", "x3", at(1, "2025-03-01"), [use("d2", "Read", file_path="/a/.bashrc"), text("x" * 2500)]),
    entry("user", "x1", "x9", at(9, "2025-03-01"), "same id again", isCompactSummary=True),
    entry("assistant", "x4", "x1", at(11, "2025-03-01"), []),
]
BROKEN = [entry("user", "b1", None, at(0), "fine"), {"type": "assistant", "uuid": "b2", "message": None}]


def write(folder, name, entries, extra=()):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(e) for e in entries]
    (folder / name).write_text("\n".join([*lines[:1], *extra, *lines[1:]]) + "\n", encoding="utf-8")

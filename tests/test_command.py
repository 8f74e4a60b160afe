import json

from loomstar.__main__ import main
from tests import fixtures as X


def test_commands(spark, tmp_path, capsys):
    X.write(tmp_path / "in" / "-home-u-projects-app", "basic.jsonl", X.BASIC)
    X.write(tmp_path / "in" / "other", "broken.jsonl", X.BROKEN)
    X.write(tmp_path / "in" / "other", "agent-1.jsonl", X.CHAIN)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    main(["all", source, out, "--dry-run"])
    assert "basic" in capsys.readouterr().out and not (tmp_path / "out").exists()
    main(["all", source, out])
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["schema"] == "star" and told["failed_sessions"] == ["broken"] and len(told["tables"]) == 28
    assert spark.read.parquet(f"{out}/fact_tool_calls").count() == 2
    main(["all", source, f"{out}2", "--format", "json", "--project", "APP"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["failed_sessions"] == []
    assert spark.read.json(f"{out}2/tables/sessions").count() == 1
    main(["query", source, "tool_usage_by_category"])
    assert "file_operations" in capsys.readouterr().out
    main(["schema", str(tmp_path / "in" / "-home-u-projects-app" / "basic.jsonl")])
    assert "$.message.content[]" in capsys.readouterr().out


def test_import_lists_and_writes(spark, tmp_path, capsys):
    talk = {"uuid": "abcdefghij", "name": "A talk", "updated_at": "2025-02-03T04:05:06Z", "chat_messages": [{"uuid": "m", "sender": "human", "created_at": "2025-02-03T04:05:06Z", "text": "hi", "content": []}]}
    (tmp_path / "conversations.json").write_text(json.dumps([talk]))
    main(["import", str(tmp_path), "--list"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"session_no": 0, "short_id": "abcdefgh", "updated": "2025-02-03", "n_messages": 1, "name": "A talk"}
    main(["import", str(tmp_path), str(tmp_path / "out")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["messages"] == 1

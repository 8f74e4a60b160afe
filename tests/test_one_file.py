"""Single files that many tasks write, and documents that many tasks read."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomstar.sources import ordered_text, sinks


@pytest.fixture
def many_tasks(spark):
    """Small splits, and no range joined with another."""
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_no_task_writes_all_lines(spark, tmp_path, many_tasks):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before, target = set(shared.glob("*/*/part-*")), tmp_path / "new" / "lines.txt"
    rows = spark.range(3000).select((3000 - F.col("id")).alias("n"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("t"))
    for _ in range(2):  # a second run replaces the first
        sinks.write_lines(spark, rows, ["n"], "t", str(target))
        assert target.read_text() == "".join(f"é {i}\n" for i in range(2999, -1, -1))
        assert [r["value"] for r in spark.read.text(str(target)).limit(2).collect()] == ["é 2999", "é 2998"]
    sizes = [p.stat().st_size for p in set(shared.glob("*/*/part-*")) - before]
    assert len(sizes) > 4 and max(sizes) < 0.6 * target.stat().st_size
    sinks.write_lines(spark, rows.limit(0), ["n"], "t", str(target))
    assert target.read_text() == ""


def test_a_file_system_that_joins_files(spark, tmp_path):
    jvm, at = spark.sparkContext._jvm, jvm_path(spark)
    for k in range(3):
        (tmp_path / f"part-{k}").write_text(f"{k}\n")
    raw = jvm.org.apache.hadoop.fs.RawLocalFileSystem()  # which copies, as no other file system is at hand
    raw.initialize(jvm.java.net.URI.create("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    local = at(tmp_path / "part-0").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [at(tmp_path / f"part-{k}") for k in range(3)]
    assert not sinks.concatenated(spark, local, parts, at(tmp_path / "all"))
    assert sinks.concatenated(spark, raw, parts, at(tmp_path / "all")) and (tmp_path / "all").read_text() == "0\n1\n2\n"
    assert sinks.concatenated(spark, raw, [], at(tmp_path / "none")) and (tmp_path / "none").read_text() == ""


def jvm_path(spark):
    return lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(p))


@pytest.mark.parametrize("layout", ["ours", "plain", "indented", "tight"])
def test_documents_are_read_in_splits(spark, tmp_path, many_tasks, layout):
    odd = ['}]}', '{"tables": {"x": [{', 'q"}\\', "\n]\n,", "[]", "é", "", "\\\\\"[{"]
    tables = {"none": [], "a \"b\": [": [{"id": i, "t": odd[i % 8] * (i % 5), "n": None} for i in range(300)], "nested": [{"x": {"y": [{"z": i}, {}]}, "l": [[i], []]} for i in range(40)], "empty": [], "last": [{}, {"k": "v"}], "end": []}
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    if layout == "ours":
        kinds = {"a \"b\": [": "id int, t string, n string", "nested": "x struct<y array<struct<z int>>>, l array<array<int>>", "last": "k string"}
        sinks.write_document(spark, {k: spark.createDataFrame([tuple(r.values()) or (None,) for r in rows] if k != "nested" else [((([(r["x"]["y"][0]["z"],), (None,)],)), r["l"]) for r in rows], kinds.get(k, "k string")) for k, rows in tables.items()}, str(folder / "a.json"))
    else:
        whole = {"version": "1.0", "schema_type": "simple", "odd": '}{"', "n": -1.5, "none": None, "tables": tables}
        for name in ("a.json", "b.json"):
            (folder / name).write_text(json.dumps(whole, indent=2 if layout == "indented" else None, separators=(",", ":") if layout == "tight" else None))
    found = ordered_text.document_rows(spark, str(folder)).collect()
    for p in folder.iterdir():
        told = json.loads(p.read_text())
        rows = sorted((r for r in found if r["path"].endswith(p.name)), key=lambda r: r["nth"])
        assert [(r["table_name"], json.loads(r["element"])) for r in rows] == [(k, row) for k, v in told["tables"].items() for row in v]
        assert all(json.loads(r["head"]) == {k: v for k, v in told.items() if k != "tables"} for r in rows)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3

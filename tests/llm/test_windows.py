"""The windows of documents that a shuffle carries."""

from loomstar.llm import decontamination


def test_document_windows_hold_no_text_and_no_marker(spark):
    docs = spark.createDataFrame([(1, "A b c d"), (2, None), (3, "e")], "doc_id long, text string")
    rows = decontamination.document_windows(docs, [1, 3])
    assert "w" not in rows.columns
    assert sorted((r["doc_id"], r["n_words"], r["at"], r["size"], r["words"]) for r in rows.collect()) == [(1, 4, 1, 1, ["a"]), (1, 4, 1, 3, ["a", "b", "c"]), (1, 4, 2, 1, ["b"]), (1, 4, 2, 3, ["b", "c", "d"]), (1, 4, 3, 1, ["c"]), (1, 4, 4, 1, ["d"]), (3, 1, 1, 1, ["e"])]

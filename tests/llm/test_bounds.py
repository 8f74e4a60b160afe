"""Bounds that hold whatever the input: rows sampled for training, announced sizes of pictures, hot and missing keys."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstar.llm import common, decontamination, media_png, neardup, packing, sharding, toxicity_mil, warc_revisits
from loomstar.llm.media_png import PASSES, SIGNATURE, chunk


def test_one_row_of_a_sampled_id(spark):
    docs = spark.createDataFrame([(i % 20 if i < 400 else 3, f"text {i} bad" if i % 2 else f"text {i} good", i) for i in range(3000)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    sample, _ = common.label_sample(labels, "toxic", F.lit(True), 10)
    rows = common.sample_texts(docs, sample, ["text", "n_chars"])
    got = rows.collect()
    assert len(got) == 20 and rows.columns == ["doc_id", "text", "n_chars", "label"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, common.sample_texts(docs.repartition(9), sample, ["text", "n_chars"]).collect()))
    assert len(toxicity_mil.fit(docs, labels, F.lit(True), per_class=10).weight)


def png(samples, bits, colour, palette=None, interlaced=0):
    """A plain file by definition: samples height x width x n, rows without filter, one bit after the other."""
    height, width, n = samples.shape
    body = b""
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        for row in part.reshape(len(part), -1).tolist():
            text = "".join(format(v, f"0{bits}b") for v in row)
            text += "0" * (-len(text) % 8)
            body += b"\0" + bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)
    return SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
def test_all_kinds_of_samples(interlaced):
    rng = np.random.default_rng(1)
    for colour, depths in media_png.DEPTHS.items():
        for bits in depths:
            for height, width in ((1, 1), (3, 5), (8, 8), (17, 13)):
                samples = rng.integers(0, 2**bits, (height, width, media_png.SAMPLES[colour]))
                palette = rng.integers(0, 256, 3 * 2**bits).astype(np.uint8).tobytes() if colour == 3 else None
                got = media_png.decode_png(png(samples, bits, colour, palette, interlaced))
                want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[:, :, 0]] if colour == 3 else samples
                assert (got == want).all() and got.shape == want.shape


def test_headers_that_announce_too_much(spark):
    small = zlib.compress(b"\0" * 4)
    made = lambda w, h, bits=8, colour=2, body=small: SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
    bad = [made(0xFFFFFFFF, 0xFFFFFFFF), made(0x7FFFFFFF, 1), made(1, 0x7FFFFFFF, 16, 6), made(0, 5), made(5, 0), made(1, 1, 3), made(1, 1, 8, 5), made(1, 1, 8, 3), made(20_000, 20_000, 8, 6, zlib.compress(bytes(10_000_000)))]
    bad.append(png(np.full((2, 2, 1), 3), 2, 3, b"abcdef"))
    for data in bad:
        with pytest.raises(ValueError):
            media_png.decode_png(data)
    rows = media_png.read_images(spark.createDataFrame(list(enumerate(bad)), "doc_id long, media binary")).collect()
    assert len(rows) == len(bad) and all(r["error"] and r["feature"] is None for r in rows)


def test_sets_of_rows_without_id_are_no_product(spark):
    """2,000 different texts without id: as many sets, not their square."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(2000)], "doc_id long, text string")
    rows = neardup.sketched(docs).withColumn("node", F.monotonically_increasing_id())
    sets = neardup.full_sets(docs, rows.select("node", "doc_id", "text_hash", "fingerprint"), False)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert sets.count() == 2000 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_salted_and_anti_joins(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    often = common.written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n")), "often")
    other = common.written(often.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), "other")
    want = sorted(map(tuple, rows.join(other, "k").collect()))
    assert sorted(map(tuple, common.salted_join(rows, other, "k", "_n", 3000).select("k", "v", "_n", "x").collect())) == want
    some = common.written(often.where("k % 2 = 0"), "some")
    assert sorted(map(tuple, common.spread_anti(rows, some, "k", "_n", 3000).collect())) == sorted(map(tuple, rows.join(some, "k", "left_anti").collect()))


def test_repeats_and_rows_without_id(spark, tmp_path):
    same = [(None, "same text here")] * 700 + [(5, "same text here")] * 300 + [(i, f"text {i}") for i in range(100, 400)]
    docs = spark.createDataFrame(same, "doc_id long, text string").repartition(6)
    packed = packing.pack(docs).collect()
    assert len(packed) == len(same) and len({(r["bucket"], r["batch"], r["place"]) for r in packed}) == len(same)
    items = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    judged = decontamination.judge(docs, items)
    assert judged.count() == len(same) and judged.where("contaminated").count() == 1000
    shards = sharding.shard(docs, 4, str(tmp_path / "map")).collect()
    assert len(shards) == len(same) and len({r["virtual_slot"] for r in shards if r["doc_id"] is None}) > 300
    (tmp_path / "died").mkdir()  # a folder whose first write died
    assert sharding.load_map(spark, str(tmp_path / "died")) is None
    assert sharding.shard(docs, 4, str(tmp_path / "died")).count() == len(same)


def test_a_response_without_id_is_found(spark):
    rows = [(None, "http://a.b/x", 10, "response", {"etag": "1"}), (7, "http://a.b/x", 20, "revisit", {"etag": "1"}), (3, "http://a.b/y", 10, "response", {"etag": "2"}), (None, "http://a.b/y", 10, "response", {"etag": "9"}), (8, "http://a.b/y", 20, "revisit", {"etag": "2"})]
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in warc_revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")).collect()}
    assert got == {7: ("match", None), 8: ("match", 3)}

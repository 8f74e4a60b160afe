"""The scores of the two classifiers' queries, row by row, from the fitted model and the definitions."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstar.llm import QUERIES, common, quality_fm, toxicity_mil
from tests.llm.test_operators import edge, empty  # noqa: F401


def tables(spark, d):
    return (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))


def plain_statistics(raw):
    n, words = len(raw), raw.lower().split()
    kinds = [lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b in (32, 9), lambda b: b in (10, 13), lambda b: b >= 128, lambda b: 33 <= b <= 126 and not chr(b).isalnum(), lambda b: b == ord("!"), lambda b: b == ord("|"), lambda b: b in b"%#$&*", lambda b: b in b".,;:?", lambda b: b in b"<>{}[]=_/\\"]
    of = [0] * 256
    for b in raw:
        of[b] += 1
    shares = [sum(of[b] for b in range(256) if k(b)) / max(1, n) for k in kinds]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    often = {w: words.count(w) for w in set(words)} if len(words) < 2000 else {}
    for w in words if not often else ():
        often[w] = often.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    m = max(1, len(words))
    ends = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return often, [*shares, math.log1p(n), math.log1p(len(words)), max(1, n) / m / 10, len(often) / m, max(often.values(), default=0) / m, same / m, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), ends / max(1, len(lines))]


def plain_quality(model, text, n_chars):
    often, stats = plain_statistics((text or "").encode("utf-8", "replace"))
    x = {w: math.log1p(n) for w, n in often.items()}
    length = max(1e-6, math.sqrt(sum(v * v for v in x.values())))
    dense = [max(-4.0, min(4.0, (s - m) / d)) / 2 for s, m, d in zip([*stats, math.log1p(abs(n_chars or 0))], model.mean, model.deviation, strict=True)]
    at = [zlib.crc32(w) % quality_fm.SLOTS for w in x] + [quality_fm.SLOTS + i for i in range(len(dense))]
    value = np.array([v / length for v in x.values()] + dense)
    own = model.factor[at].astype(np.float64) * value[:, None]
    before = np.vstack([np.zeros(own.shape[1]), np.cumsum(own, axis=0)[:-1]])
    pairs = float((own * before).sum())  # each feature with all those before it
    z = model.bias + float(model.weight[at].astype(np.float64) @ value) + pairs + model.shift
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def plain_toxicity(model, text):
    clean = "".join("\n" if c in ".!?\n\r" else c.lower() if "A" <= c <= "Z" else c if ord(c) >= 128 or c.isalnum() else " " for c in text or "")
    logits = []
    for sentence in clean.split("\n"):
        words = {w for w in sentence.encode("utf-8", "replace").split()}
        if words:
            parts = [p for w in words for p in [w, *[b"^" + w[:n] for n in (3, 4, 5, 6) if n < len(w)], *[b"$" + w[-n:] for n in (3, 4, 5) if n < len(w)]]]
            logits.append(model.bias + sum(float(model.weight[zlib.crc32(p) % toxicity_mil.SLOTS]) for p in parts))
    harmless = 1.0
    for z in logits:
        harmless *= 1 - 1 / (1 + math.exp(-z)) if z > -700 else 1.0
    bad = sum(z >= 0 for z in logits)
    score = model.odds * (1 - harmless) / (model.odds * (1 - harmless) + harmless) if logits and harmless < 1 else 0.0
    return score, len(logits), bad


def close(got, want, at):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:at] + r[at + 1 :] for r in got] == [r[:at] + r[at + 1 :] for r in want]
    assert [r[at] for r in got] == pytest.approx([r[at] for r in want], abs=2e-4)


def test_quality_scores(spark, edge, sf_dir):  # noqa: F811
    for d in (edge, sf_dir):
        docs, labels = tables(spark, d)
        held = F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False))
        model = quality_fm.fit(docs, labels, ~held, metadata=("n_chars",))
        rows = docs.select("doc_id", "text", "n_chars").collect()
        hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        want = [(r["doc_id"], hold(r["doc_id"]), plain_quality(model, r["text"], r["n_chars"])) for r in rows]
        got = [(r["doc_id"], r["held_out"], r["score"]) for r in QUERIES["op1_quality_fm"](spark, d).collect()]
        close(got, want, 2)


def test_toxicity_scores(spark, edge, sf_dir):  # noqa: F811
    for d in (edge, sf_dir):
        docs, labels = tables(spark, d)
        held = F.coalesce(common.fold(F.col("doc_id"), 4) == 2, F.lit(False))
        model = toxicity_mil.fit(docs, labels, ~held)
        hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        want = []
        for r in docs.select("doc_id", "text").collect():
            score, n, bad = plain_toxicity(model, r["text"])
            want.append((r["doc_id"], hold(r["doc_id"]), n, bad, score))
        got = [(r["doc_id"], r["held_out"], r["n_sentences"], r["n_offending"], r["score"]) for r in QUERIES["op5_toxicity_mil"](spark, d).collect()]
        close(got, want, 4)
        assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in QUERIES["op5_toxicity_mil"](spark, d).collect())

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise term of n features is not summed over pairs but, factor by factor, as half of (sum of v x) squared
minus the sum of (v x) squared, so that a text is scored in time linear in its distinct words.

Edge cases: a null text counts as an empty one; an empty text has its statistics alone and still gets a score; null
metadata add nothing; repeated rows are scored each; an empty table gives an empty result; without labelled rows of
both classes the score is the share of label 1 (0.5 without any); ids of training rows are long integers. Further columns
are ignored, or kept by name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

SLOTS, FACTORS, CHUNK, KNOWN_WORDS = 1 << 15, 8, 256, 300_000
#: Bytes counted by kind: upper case, lower case, digits, spaces, line ends, beyond ASCII, other, and some marks.
KINDS = [range(65, 91), range(97, 123), range(48, 58), (32, 9), (10, 13), range(128, 256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], b"!", b"|", b"%#$&*", b".,;:?", b"<>{}[]=_/\\"]
BY_KIND = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS):
    BY_KIND[list(_bytes), _k] = 1
N_STATS = len(KINDS) + 9


class Slots(dict):
    """Word to slot, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = slot = zlib.crc32(word) % SLOTS
        return slot


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, w = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ BY_KIND / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines))
    top = max(counts.values(), default=0)
    return [*kinds, np.log1p(len(text)), np.log1p(len(words)), n / w / 10, len(counts) / w, top / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), ends]


def features(texts: list[str | None], metadata: np.ndarray, slots: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each distinct word, its value, number of words of each text, dense statistics with the metadata)."""
    index, value, sizes, dense = [], [], [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        words = raw.lower().split()
        counts = Counter(words)
        x = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        index.append(np.fromiter(map(slots.__getitem__, counts), np.int32, len(counts)))
        value.append(x / max(1e-6, float(np.sqrt(x @ x))))
        sizes.append(len(counts))
        dense.append(statistics(raw, words, counts))
    stats = np.array(dense, np.float32).reshape(len(texts), N_STATS)
    return np.concatenate([np.zeros(0, np.int32), *index]), np.concatenate([np.zeros(0, np.float32), *value]), np.array(sizes, np.int64), np.hstack([stats, np.log1p(np.abs(np.nan_to_num(metadata, nan=0.0))).astype(np.float32)])


def sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row sums of consecutive runs, 0 for empty runs."""
    out = np.zeros((len(sizes), *rows.shape[1:]), np.float64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


@dataclass
class FactorisationMachine:
    """bias, linear weights and factors: those of the word slots first, those of the dense features after them."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    shift: float = 0.0

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.deviation, -4, 4) / 2

    def logits(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, d = self.factor[index] * value[:, None], self.factor[SLOTS:]
        total = sums(v, sizes) + dense @ d
        squares = sums((v * v).sum(1), sizes) + (dense * dense) @ (d * d).sum(1)
        linear = sums(self.weight[index] * value, sizes) + dense @ self.weight[SLOTS:]
        return self.bias + linear + ((total * total).sum(1) - squares) / 2, total

    def scores(self, texts: list[str | None], metadata: np.ndarray, slots: Slots) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(texts), CHUNK):
            index, value, sizes, stats = features(texts[at : at + CHUNK], metadata[at : at + CHUNK], slots)
            out.append(self.logits(index, value, sizes, self.dense(stats))[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) + self.shift, -60, 60)))


def constant(share: float, n_dense: int) -> FactorisationMachine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SLOTS + n_dense), np.zeros((SLOTS + n_dense, FACTORS)), np.zeros(n_dense), np.ones(n_dense))


def train(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, stats: np.ndarray, label: np.ndarray, share: float, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad over minibatches of the bounded sample, always in the same order."""
    rng, n_dense = np.random.default_rng(seed), stats.shape[1]
    fm = constant(0.5, n_dense)
    fm.factor = rng.normal(0, 0.01, fm.factor.shape)
    fm.mean, fm.deviation = stats.mean(0), stats.std(0) + 1e-3
    dense, starts = fm.dense(stats), np.cumsum(sizes) - sizes
    gw, gv, gb = np.full(len(fm.weight), 1e-6), np.full(fm.factor.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), CHUNK):
            rows = order[at : at + CHUNK]
            own, n = sizes[rows], len(rows)
            take = np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            i, x, d = index[take], value[take], dense[rows]
            z, total = fm.logits(i, x, own, d)
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[rows]) / n
            gx = np.repeat(g, own) * x
            used, back = np.unique(i, return_inverse=True)
            by_word = gx[:, None] * (np.repeat(total, own, axis=0) - fm.factor[i] * x[:, None])
            word_v = np.stack([np.bincount(back, by_word[:, f], len(used)) for f in range(FACTORS)], 1)
            dense_v = d.T @ (g[:, None] * total) - fm.factor[SLOTS:] * ((d * d).T @ g)[:, None]
            slots = np.concatenate([used, np.arange(SLOTS, SLOTS + n_dense)])
            dw = np.concatenate([np.bincount(back, gx, len(used)), d.T @ g]) + decay * fm.weight[slots]
            dv = np.concatenate([word_v, dense_v]) + decay * fm.factor[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            gb += g.sum() ** 2
            fm.weight[slots] -= rate * dw / np.sqrt(gw[slots])
            fm.factor[slots] -= rate * dv / np.sqrt(gv[slots]) / 4
            fm.bias -= rate * g.sum() / np.sqrt(gb)
    own = label.mean()
    fm.shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(own / (1 - own)))
    fm.weight, fm.factor = fm.weight.astype(np.float32), fm.factor.astype(np.float32)
    return fm


def metadata_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    columns = [np.array([np.nan if x is None else float(x) for x in batch.column(n).to_pylist()], np.float64) for n in names]
    return np.stack(columns, 1) if columns else np.zeros((batch.num_rows, 0))


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", metadata: tuple[str, ...] = (), per_class: int = 4000) -> FactorisationMachine:
    """Fits on at most per_class labelled rows of each class; Spark makes their features, the driver gets only those."""
    names = list(metadata)
    sample, share = common.label_sample(labels, label, training, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in common.slices(batches):
            texts, meta = b.column("text").to_pylist(), metadata_of(b, names)
            index, value, sizes, stats = features(texts, meta, slots)
            ends = np.cumsum(sizes)[:-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(np.split(index, ends), pa.list_(pa.int32())), pa.array(np.split(value, ends), pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float32()))], ["doc_id", "label", "slot", "value", "stats"])

    rows = common.sample_texts(docs, sample, ["text", *names]).mapInArrow(extract, "doc_id long, label int, slot array<int>, value array<float>, stats array<float>").toArrow().combine_chunks()
    n_dense = N_STATS + len(names)
    label_of = rows["label"].to_numpy()
    if rows.num_rows == 0 or label_of.min() == label_of.max():
        return constant(share if rows.num_rows else 0.5, n_dense)
    slot, value, stats = (rows[c].combine_chunks() for c in ("slot", "value", "stats"))
    size = np.diff(slot.offsets.to_numpy())
    first, flat_i, flat_x = slot.offsets.to_numpy()[:-1], slot.values.to_numpy(), value.values.to_numpy()
    order = np.lexsort((size, rows["doc_id"].to_numpy()))  # the same rows in the same order, however they were dealt
    take = np.repeat(first[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(size.sum())
    return train(flat_i[take], flat_x[take], size[order].astype(np.int64), stats.values.to_numpy().reshape(-1, n_dense)[order], label_of[order].astype(np.float64), share)


def score(docs: DataFrame, model: FactorisationMachine, metadata: tuple[str, ...] = (), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and score: the probability of label 1. One narrow pass; the model goes out once."""
    names, shared = list(metadata), docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm, slots = shared.value, Slots()
        for b in common.slices(batches):
            got = fm.scores(b.column("_text").to_pylist(), metadata_of(b, [f"_m{i}" for i in range(len(names))]), slots)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(got)], [*keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)
    return own.mapInArrow(run, f"{kinds}, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, metadata: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns and without a shuffle."""
    names, shared = list(metadata), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm, slots = shared.value, Slots()
        for b in common.slices(batches):
            yield b.filter(pa.array(fm.scores(b.column("text").to_pylist(), metadata_of(b, names), slots) >= threshold))

    return docs.mapInArrow(run, docs.schema)

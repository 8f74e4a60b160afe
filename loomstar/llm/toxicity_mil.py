"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or joins them, documents alone carry labels.

A sentence's probability is a logistic function of its distinct words, each by the word and its beginnings and ends
(hashed), so that an unseen word of a known stem counts; a document is toxic unless all its sentences are harmless: P = 1 - prod(1 - p). The gradient of that likelihood trains the sentence scorer from document
labels, and the same scorer then locates the offending sentences.

Edge cases: a null or empty text has no sentence and score 0 before the share of label 1 is allowed for, so 0 after;
repeated rows are scored each; an empty table gives an empty result; without labelled rows of both classes every text
that has a sentence gets the share of label 1; ids of training rows and of locate() are long integers. Further columns are
ignored, or kept by name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstar.llm import common

SLOTS, KNOWN_WORDS = 1 << 18, 300_000
#: A-Z lower-cased, ends of sentences and lines to a line end, every other mark to a space.
PLAIN = bytes(10 if i in b".!?\n\r" else i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def sentences(text: str | None) -> list[bytes]:
    return [s for s in (text or "").encode("utf-8", "replace").translate(PLAIN).split(b"\n") if s and not s.isspace()]


def slots_of(word: bytes) -> list[int]:
    """Slots of a word: its own, those of its beginnings of 3 to 6 bytes and of its ends of 3 to 5, as far as it has them."""
    parts = [word, *[b"^" + word[:n] for n in range(3, min(7, len(word)))], *[b"$" + word[-n:] for n in range(3, min(6, len(word)))]]
    return [zlib.crc32(x) % SLOTS for x in parts]


class Weights(dict):
    """Word to weight, kept for the words seen last."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: bytes) -> float:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = w = float(self.weight[slots_of(word)].sum())
        return w


@dataclass
class NoisyOr:
    weight: np.ndarray
    bias: float
    odds: float = 1.0

    def sentence_logits(self, found: list[bytes], known: Weights) -> np.ndarray:
        get = known.__getitem__
        return np.fromiter((sum(map(get, set(s.split()))) for s in found), np.float64, len(found)) + self.bias

    def document(self, logits: np.ndarray) -> float:
        """Noisy-or over the sentences, with the odds set right for the share of label 1 in the sample."""
        none = float(np.exp(-np.logaddexp(0, logits).sum()))
        return self.odds * (1 - none) / (self.odds * (1 - none) + none) if none < 1 else 0.0


def train(word: np.ndarray, vocabulary: pa.Array, words: np.ndarray, per_doc: np.ndarray, label: np.ndarray, share: float, steps: int = 300, rate: float = 0.05, sparse: float = 3e-4, least: int = 8) -> NoisyOr:
    """Adam on the noisy-or likelihood of a bounded sample, with weights drawn to zero (sparse), so that few stems have one.

    word: place in the vocabulary of each distinct word of each sentence; words: how many of each sentence; per_doc:
    sentences of each document; least: how often a slot occurs at least, to get a weight.
    """
    sentence_of = np.repeat(np.arange(len(words), dtype=np.int32), words)
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    n_words, flat, sizes = len(vocabulary), array("i"), array("i")  # plain arrays: the driver's memory is small
    for x in vocabulary:
        found = slots_of(x.as_py())
        flat.extend(found)
        sizes.append(len(found))
    slot = np.frombuffer(flat, np.int32)
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), np.frombuffer(sizes, np.int32))
    often = np.bincount(slot, np.bincount(word, minlength=n_words)[word_of], SLOTS) >= least
    word_of, slot = word_of[often[slot]], slot[often[slot]]
    names, own = np.unique(slot, return_inverse=True)
    w, b = np.zeros(len(names)), -5.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, steps + 1):
        of_word = np.bincount(word_of, w[own], n_words)
        z = b + np.bincount(sentence_of, of_word[word], len(words))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), len(per_doc)))
        pull = np.where(label == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = pull[doc_of] * p / len(label)
        by_word = np.bincount(word, g[sentence_of], n_words)
        gw, gb = np.bincount(own, by_word[word_of], len(names)), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        step = rate / (np.sqrt(v / c) + 1e-6)
        w -= step * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    weight = np.zeros(SLOTS, np.float32)
    weight[names] = w
    ours = label.mean()
    return NoisyOr(weight, float(b), float(share / max(1 - share, 1e-6) * (1 - ours) / ours))


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", per_class: int = 2500) -> NoisyOr:
    """Fits on at most per_class labelled rows of each class; Spark splits their sentences."""
    sample, share = common.label_sample(labels, label, training, per_class)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            bags = [[sorted(set(s.split())) for s in sentences(t)] for t in b.column("text").to_pylist()]
            flat = [[x for s in bag for x in s] for bag in bags]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(flat, pa.list_(pa.binary())), pa.array([list(map(len, bag)) for bag in bags], pa.list_(pa.int32()))], ["doc_id", "label", "word", "words"])

    rows = common.sample_texts(docs, sample, ["text"]).mapInArrow(extract, "doc_id long, label int, word array<binary>, words array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    label_of = rows["label"].to_numpy()
    if rows.num_rows == 0 or label_of.min() == label_of.max():
        share = min(max(share if rows.num_rows else 0.5, 1e-6), 1 - 1e-6)
        return NoisyOr(np.zeros(SLOTS, np.float32), 40.0, share / (1 - share) * 1e-17)
    word, words = rows["word"].combine_chunks().flatten().dictionary_encode(), rows["words"].combine_chunks()
    return train(word.indices.to_numpy(), word.dictionary, words.values.to_numpy(), np.diff(words.offsets.to_numpy()), label_of, share)


def score(docs: DataFrame, model: NoisyOr, keep: tuple[str, ...] = ("doc_id",), offending: float = 0.5) -> DataFrame:
    """The columns of keep, score, the number of sentences, of offending ones, and the worst one's place (0-based; null without sentences)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(shared.value.weight)
        for b in common.slices(batches):
            got, n, bad, worst = [], [], [], []
            for text in b.column("_text").to_pylist():
                z = shared.value.sentence_logits(sentences(text), known)
                got.append(shared.value.document(z))
                n.append(len(z))
                bad.append(int((z >= np.log(offending / (1 - offending))).sum()))
                worst.append(int(z.argmax()) if len(z) else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(got, pa.float64()), pa.array(n, pa.int32()), pa.array(bad, pa.int32()), pa.array(worst, pa.int32())], [*keep, "score", "n_sentences", "n_offending", "worst_sentence"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)
    return own.mapInArrow(run, f"{kinds}, score double, n_sentences int, n_offending int, worst_sentence int")


def locate(docs: DataFrame, model: NoisyOr, offending: float = 0.5) -> DataFrame:
    """doc_id, place, text and probability of every offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(shared.value.weight)
        for b in common.slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                shown = [s for s in re.split(r"[.!?\n\r]", text or "") if (q := s.encode("utf-8", "replace").translate(PLAIN)) and not q.isspace()]
                p = 1 / (1 + np.exp(-shared.value.sentence_logits(sentences(text), known)))
                out += [(doc_id, int(i), shown[i].strip(), float(p[i])) for i in np.flatnonzero(p >= offending)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], ["doc_id", "sentence", "text", "probability"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence int, text string, probability double")


def keep_harmless(docs: DataFrame, model: NoisyOr, threshold: float = 0.3) -> DataFrame:
    """The rows whose score stays under the threshold, with all their columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(shared.value.weight)
        for b in common.slices(batches):
            yield b.filter(pa.array([shared.value.document(shared.value.sentence_logits(sentences(t), known)) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

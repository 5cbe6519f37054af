"""Quality classifier by attention-based multiple-instance learning.

Method. A document is a bag of passages of `PASSAGE` words; labels are known for documents only. Every passage is
encoded (shares of byte classes, word shapes, repeated words and hashed words, then one learned tanh layer); a gated
attention a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), learned from the documents' labels, weighs the passages; a
logistic unit scores the weighted sum. Gradients are written out below, so NumPy is all that tasks need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textarrays import slices, text_bytes, words_of

PASSAGE, HIDDEN, GATE, WORD_BUCKETS = 64, 24, 12, 48


def _byte_classes() -> np.ndarray:
    """0 lower vowel, 1 other lower, 2 upper, 3 digit, 4 space, 5 other, 6 lead byte of other scripts, 7 rest of
    such characters, then one class for each ASCII punctuation mark."""
    marks = {c: i + 8 for i, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}

    def kind(b: int) -> int:
        if b in marks:
            return marks[b]
        if b >= 128:
            return 6 if b >= 192 else 7
        c = chr(b)
        return 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5

    return np.array([kind(b) for b in range(256)])


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
_UPPER, _ALNUM = _CLASS == 2, np.isin(_CLASS, (0, 1, 2, 3, 6, 7))
WIDTH = _CLASSES + WORD_BUCKETS + 7


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text); a text without words has one passage of zeros."""
    words = words_of(texts)
    number = np.maximum(1, -(-words.count // PASSAGE))
    base = np.concatenate(([0], np.cumsum(number)))
    x = np.zeros((base[-1], WIDTH), np.float32)
    if not len(words.doc):
        return x, number
    within = np.arange(len(words.doc)) - words.first[words.doc]
    part = base[words.doc] + within // PASSAGE
    size = np.bincount(part, minlength=len(x)).astype(np.float64)
    x[:, -1] = size / PASSAGE
    size[size == 0] = 1
    of_byte = np.repeat(part, np.diff(np.append(words.start, len(words.data))))
    classes = np.bincount(of_byte * _CLASSES + _CLASS[words.data], minlength=len(x) * _CLASSES).reshape(len(x), -1)
    classes[:, _CLASS[32]] = 0  # only what joins words here, so a passage's features don't depend on what follows it
    x[:, :_CLASSES] = np.sqrt(classes / np.maximum(1, classes.sum(1, keepdims=True)))
    hashes = words.hashes()
    buckets = np.bincount(part * WORD_BUCKETS + (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=len(x) * WORD_BUCKETS)
    x[:, _CLASSES : _CLASSES + WORD_BUCKETS] = np.sqrt(buckets.reshape(len(x), -1) / size[:, None])
    length = words.end - words.start
    upper = np.concatenate(([0], np.cumsum(_UPPER[words.data])))
    alnum = np.concatenate(([0], np.cumsum(_ALNUM[words.data])))
    order = np.lexsort((hashes, part))
    again = np.zeros(len(part), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (part[order[1:]] == part[order[:-1]])
    shapes = (
        length / 10,
        length > 20,
        upper[words.end] - upper[words.start] >= np.maximum(2, length / 2),
        ~_ALNUM[words.data[words.end - 1]],
        alnum[words.end] - alnum[words.start] == 0,
        again,
    )
    for i, value in enumerate(shapes):
        x[:, _CLASSES + WORD_BUCKETS + i] = np.bincount(part, weights=value, minlength=len(x)) / size
    return x, number


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Weights in one flat vector, so that they can be averaged."""

    SHAPES = {"E": (WIDTH, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 7):
        sizes = {k: int(np.prod(s)) for k, s in self.SHAPES.items()}
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 1 / np.sqrt(s[0]), sizes[k]) * (len(s) == 2 or k == "w") for k, s in self.SHAPES.items()])
        self.flat, at = flat, 0
        for k, shape in self.SHAPES.items():
            setattr(self, k, flat[at : at + sizes[k]].reshape(shape))
            at += sizes[k]

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        start = np.concatenate(([0], np.cumsum(number)[:-1]))
        doc = np.repeat(np.arange(len(number)), number)
        h = np.tanh(x @ self.E + self.e)
        t, g = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        s = (t * g) @ self.w
        a = np.exp(s - np.maximum.reduceat(s, start)[doc])
        a /= np.add.reduceat(a, start)[doc]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"start": start, "doc": doc, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ self.c + self.b[0])}

    def gradient(self, x: np.ndarray, number: np.ndarray, y: np.ndarray, decay: float) -> np.ndarray:
        """Of the mean log loss plus decay/2 times the squared weights."""
        f = self.forward(x, number)
        doc, h, t, g, a = f["doc"], f["h"], f["t"], f["g"], f["a"]
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * self.c
        da = (dz[doc] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, f["start"])[doc])
        dt, dg = ds[:, None] * self.w * g * (1 - t * t), ds[:, None] * self.w * t * g * (1 - g)
        dh = (a[:, None] * dz[doc] + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        parts = {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": f["z"].T @ d, "b": np.array([d.sum()])}
        return np.concatenate([parts[k].ravel() for k in self.SHAPES]) + decay * self.flat

    def fit(self, bags: list[tuple[np.ndarray, float]], steps: int, rate: float, decay: float, seed: int, batch: int = 64) -> np.ndarray:
        """Adam over batches of bags, shuffled anew when all were seen; returns the new flat vector."""
        rng, m, v, order = np.random.default_rng(seed), np.zeros_like(self.flat), np.zeros_like(self.flat), []
        for step in range(1, steps + 1):
            while len(order) < min(batch, len(bags)):
                order += rng.permutation(len(bags)).tolist()
            own, order = [bags[i] for i in order[:batch]], order[batch:]
            grad = self.gradient(np.concatenate([b[0] for b in own]), np.array([len(b[0]) for b in own]), np.array([b[1] for b in own]), decay)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            self.flat -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self.flat


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents that are `usable`, least hash of the id first.

    A doc_id with several labels takes the least, and one with several rows the least text; null labels and ids are
    left out.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # At most `most` rows of two numbers: a proven bound.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def _shard_trainer(flat: np.ndarray, turn: int, steps: int, rate: float, decay: float) -> Callable:
    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "bag"], kind="stable")
        own = [(np.frombuffer(b, np.float32).reshape(-1, WIDTH), y) for b, y in zip(rows["bag"], rows["label"])]
        new = AttentionModel(flat.copy()).fit(own, steps, rate, decay, seed=1000 * turn + int(key[0]))
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "flat": [new.tobytes()]})

    return train


def fit_attention_model(
    docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, most: int = 4096,
    shards: int = 8, rounds: int = 5, steps: int = 100, rate: float = 0.01, decay: float = 1e-5,
) -> AttentionModel:
    """Fit on a bounded sample of labelled documents (`most`, by the hash of their ids).

    Data-parallel: the sample is dealt to `shards` by id; in each round every shard trains a copy of the model for
    `steps` batches, and the copies are averaged by their numbers of documents. The driver sees weights only. Without
    labelled documents the model stays as it begins, and scores 0.5 throughout.
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, number = passages(text_bytes(batch.column("text")))
            bags = [b.tobytes() for b in np.split(x, np.cumsum(number)[:-1])] if len(number) else []
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": pa.array(bags, pa.binary())})

    bags = written(sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "label").mapInArrow(encode, "doc_id long, label double, bag binary"), "mil")
    bags = bags.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    flat = AttentionModel().flat
    for turn in range(rounds):
        train = _shard_trainer(flat, turn, steps, rate / (1 + turn / 2), decay)
        found = bags.groupBy("shard").applyInPandas(train, "shard long, n long, flat binary").orderBy("shard").collect()
        if not found:
            break
        flat = np.average([np.frombuffer(r.flat) for r in found], axis=0, weights=[r.n for r in found])
    return AttentionModel(flat)


def score_quality(docs: DataFrame, model: AttentionModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from `threshold` on), n_passages and top_weight, the largest attention,
    of each whole text. Null and empty texts are one empty passage. Rows come back one for one."""
    flat = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionModel(flat)
        for batch in slices(batches, "text"):
            x, number = passages(text_bytes(batch.column("text")))
            f = own.forward(x, number)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "score": f["score"], "predicted": (f["score"] >= threshold).astype(np.int32),
                    "n_passages": number.astype(np.int64), "top_weight": np.maximum.reduceat(f["a"], f["start"]),
                }
            )

    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return df.mapInArrow(run, "doc_id long, score double, predicted int, n_passages long, top_weight double")


def kept_by_quality(docs: DataFrame, model: AttentionModel, threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores `threshold` or more, with all their columns; nothing is shuffled."""
    flat = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionModel(flat)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(own.forward(*passages(text_bytes(batch.column("text"))))["score"] >= threshold))

    return docs.mapInArrow(run, docs.schema)

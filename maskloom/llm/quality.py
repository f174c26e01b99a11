"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage is described by what its characters and words are like and by its words,
hashed to `BUCKETS` shares, and encoded by a learnt layer; gated attention weighs the passages against each other, and the weighted sum is scored. Only the label of
the whole document is used, so the attention learns which passages give a document away. Training runs on a bounded
sample of the labelled documents (`sample`, the least by hash); scoring covers every passage of every document.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

#: Passages are lines, long ones in runs of so many words.
PASSAGE_WORDS = 60
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:"
_MARKS = b"#$%&*|!@^~<>{}[]\\/=+_"
_SPACE = b" \t\n\r\x0b\x0c"
N_SHAPE, BUCKETS = 16, 128
N_FEATURES = N_SHAPE + BUCKETS
#: Added to the spread of words' shares, so that a rare word weighs little where few documents are labelled.
WORD_SCALE = 0.3
#: Passages of a document that are learnt from: runs of a long one are dealt to so many evenly. Scoring reads them all.
TRAIN_PASSAGES = 60
_UNCASED = bytes.maketrans(_UPPER, _LOWER)
_log = logging.getLogger(__name__)


def passages(text: str) -> list[list[bytes]]:
    """The words of each passage; a text without words has one empty passage."""
    out = []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        out += [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)]
    return out or [[]]


def describe(words: list[bytes]) -> list[float]:
    """What a passage is like: shares of kinds of characters and of repeated words, lengths, how it begins and ends."""
    if not words:
        return [1.0] + [0.0] * (N_SHAPE - 1)
    s = b" ".join(words)
    n, k = len(s), len(words)
    share = lambda kind: (n - len(s.translate(None, kind))) / n
    upper, lower = share(_UPPER), share(_LOWER)
    last = b"".join(w[-1:] for w in words)
    ends = (k - len(last.translate(None, _MARKS))) / k
    repeated = sum(map(bytes.__eq__, words, words[1:])) / k
    return [
        0.0, upper, lower, share(_DIGIT), share(_STOPS), share(_MARKS), ends, repeated, 1 - len(set(words)) / k, min(n / k / 10, 3.0), k / PASSAGE_WORDS,
        float(s[:1].isupper()), float(s[-1:] in b".!?"), float(words.count(b"|")) / k, min(len(max(words, key=len)) / 30, 3.0), upper / (upper + lower + 0.01),
    ]


@lru_cache(maxsize=40_000)
def _bucket(word: bytes) -> int:
    return zlib.crc32(word.translate(_UNCASED)) % BUCKETS


def bag(text: str) -> np.ndarray:
    """A row for each passage: its shape, then the roots of its words' shares by hash bucket."""
    found = passages(text)
    shape = np.array([describe(p) for p in found], np.float32)
    sizes = np.array([len(p) for p in found])
    at = np.repeat(np.arange(len(found)), sizes) * BUCKETS + np.fromiter((_bucket(w) for p in found for w in p), np.int64, int(sizes.sum()))
    words = np.bincount(at, minlength=len(found) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(sizes, 1)[:, None]
    return np.hstack([shape, np.sqrt(words).astype(np.float32)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and scorer. Bags come stacked, with the first row of each."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"W": init(N_FEATURES, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "a": init(gate), "c": init(hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, rows = self.p, np.diff(np.append(first, len(x)))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), rows))
        a = e / np.repeat(np.add.reduceat(e, first), rows)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "rows": rows, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        err = (f["score"] - y) * weight / len(y)
        dz = np.repeat(err[:, None] * p["c"], f["rows"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["rows"]))
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err, "d": err.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: list[int], epochs: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Model:
        """Adam on the log loss, both labels weighing alike."""
        y = np.array(labels, float)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        n = sum(map(len, bags))
        self.mean = sum(b.sum(0, dtype=float) for b in bags) / n
        spread = np.sqrt(sum(((b - self.mean) ** 2).sum(0) for b in bags) / n)
        self.scale = spread + np.where(np.arange(N_FEATURES) < N_SHAPE, 1e-3, WORD_SCALE)
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                x = np.concatenate([bags[i] for i in own])
                first = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
                step += 1
                for k, g in self.gradient(x, first, y[own], weight[own]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        return self.forward(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])]))["score"]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learns from at most `sample` labelled documents that are not held out, the least by a hash of their ids.

    Rows without an id or a label are left out, of several labels for an id the largest holds, and of several texts for an
    id one is read, that with the least hash. With no document of one of the labels nothing can be learnt: None, which
    scores every document 1, so that none is rejected, and a warning is logged.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    # `sample` rows at most, so small enough to broadcast.
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    # One text for an id, however often it comes: tasks keep the least hash first, whole texts are met by it afterwards.
    hashed = texts.select("_id", "_y", "_t", F.xxhash64("_t").alias("_h"))
    one = hashed.groupBy("_id").agg(F.min("_h").alias("_h"))
    texts = hashed.join(F.broadcast(one), ["_id", "_h"]).select("_id", "_y", "_t")  # `sample` ids at most
    schema = "_id string, _y int, bag binary"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches):
            ids = batch.column(0).cast(pa.string())
            new = [i for i, x in enumerate(ids.to_pylist()) if not (x in seen or seen.add(x))]
            batch, ids = batch.take(pa.array(new, pa.int64())), ids.take(pa.array(new, pa.int64()))
            bags = []
            for t in batch.column(2).to_pylist():
                b = bag(t)
                bags.append(b[np.linspace(0, len(b) - 1, min(len(b), TRAIN_PASSAGES)).astype(int)].ravel().tobytes())
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(bags, pa.binary())], ["_id", "_y", "bag"])

    # Tasks send a repeated text once each; one of them is left.
    bags = texts.mapInArrow(described, schema).groupBy("_id").agg(F.min("_y").alias("_y"), F.min("bag").alias("bag"))
    found = sorted((r["_id"], r["_y"], bytes(r["bag"])) for r in bags.toLocalIterator())
    if len({y for _, y, _ in found}) < 2:
        _log.warning("no document of one of the labels: nothing is learnt and nothing rejected")
        return None
    return Model().fit([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, _, b in found], [y for _, y, _ in found])


def _scores(model: Model | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    return np.concatenate([model.scores([bag(t) for t in texts[i : i + 64]]) for i in range(0, len(texts), 64)] or [np.zeros(0)])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold on).

    Without a model every score is 1. Null and empty texts are a bag of one empty passage. Null ids and repeated rows are passed on as they are. No column
    but the text bears on the score, and no other than the two named is read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(2).to_pylist()
            scores = _scores(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that reach the threshold, with all their columns; all rows where there is no model."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = _scores(model, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """Learns from the labels and scores all of docs."""
    return score(docs, train(docs, labels, sample))

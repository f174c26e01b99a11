"""Toxicity: non-negative positive-unlabelled learning over how telling a text's words are.

Learnt from are documents confirmed as toxic and unlabelled ones; no document is taken as clean. Words and their
beginnings, hashed, are counted on both sides, and a word tells as much as the most telling of these: the log of how
oftener it comes among the toxic, drawn to zero where it is rare. A document is described by the densities of words at
several levels of telling; while learning, by counts of the other folds, so that no document vouches for itself. A small
network scores these by the class-prior-corrected risk: with the share of toxic documents (`prior`) known, the risk on
clean ones is that on unlabelled ones less `prior` times that on toxic ones taken as clean. Where that falls below zero
it is overfitted, and the step goes back up (the non-negative estimator). Several networks are trained and averaged.

Both samples are bounded (`sample`); scoring reads every whole text and looks each different word up once.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of
from .quality import held_out

BUCKETS = 1 << 18
#: Bytes of a word's beginning that are hashed, besides the whole word.
BEGINNINGS = (2, 3, 4, 5, 6, 8)
#: A feature counts so often in a document at most, so that junk that repeats itself weighs little.
MOST = 3
#: Added to both counts of a feature, so that a rare one tells little.
DRAWN = 2.0
#: Levels of telling at which densities are taken.
LEVELS = np.arange(1, 11) / 5
#: Added to the number of words, so that a single word of a short text doesn't decide.
SMOOTH = 20
FOLDS, MEMBERS = 8, 5
#: Different words of a document that are learnt from, spread evenly over a longer one. Scoring reads them all.
TRAIN_WORDS = 1000
#: The prior where no label says which documents are clean.
PRIOR = 0.1
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Words whose levels a task keeps at a time.
_KEPT = 200_000
_log = logging.getLogger(__name__)


def words(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def features(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings; the word's again where it is no longer than a beginning."""
    whole = zlib.crc32(word) % BUCKETS
    return [whole, *(zlib.crc32(b"^" + word[:k]) % BUCKETS if k <= len(word) else whole for k in BEGINNINGS)]


def bag(text: str) -> np.ndarray:
    """A row for each different word: how often it comes, and its buckets."""
    rows = [[n, *features(w)] for w, n in Counter(words(text)).items()]
    return np.array(rows, np.int32).reshape(-1, 2 + len(BEGINNINGS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Counts:
    """How often each bucket comes in some bags, and the words of all."""

    def __init__(self):
        self.each, self.words = np.zeros(BUCKETS), 0.0

    def add(self, one: np.ndarray, sign: int = 1) -> None:
        keys, at = np.unique(one[:, 1:], return_inverse=True)
        n = np.bincount(at.ravel(), np.repeat(one[:, 0], one.shape[1] - 1), len(keys)) if len(one) else np.zeros(0)
        self.each[keys] += sign * np.minimum(n, MOST)
        self.words += sign * float(np.minimum(one[:, 0], MOST).sum())


def telling(toxic: Counts, unlabelled: Counts) -> np.ndarray:
    """For each bucket the log of how oftener it comes among the toxic than by the unlabelled."""
    expected = unlabelled.each * (toxic.words / max(unlabelled.words, 1.0))
    return np.log((toxic.each + DRAWN) / (expected + DRAWN)).astype(np.float32)


def described(counts: np.ndarray, tells: np.ndarray) -> np.ndarray:
    """The densities of words at each level: counts and how telling each word is."""
    at = np.searchsorted(LEVELS, tells.astype(float), side="right")
    return densities(np.bincount(at, counts, len(LEVELS) + 1), counts.sum())


def densities(held: np.ndarray, total: float) -> np.ndarray:
    """held: how many words are between the levels."""
    return np.log1p(100 * held[:0:-1].cumsum()[::-1] / (total + SMOOTH))


def risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on toxic documents, risk on clean ones, which may be below zero) by the log loss of the scores."""
    lost = lambda g: float(np.logaddexp(0, g).mean())
    return prior * lost(-g_p), lost(g_u) - prior * lost(g_p)


def slopes(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the non-negative risk by each score. With a negative risk on clean documents, those that lead back up."""
    clean = risk(g_p, g_u, prior)[1]
    s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
    if clean < 0:
        return prior * s_p / len(g_p), -s_u / len(g_u)
    return np.full(len(g_p), -prior / len(g_p)), s_u / len(g_u)


class Classifier:
    """One hidden layer over the densities, without negative weights: more telling words never make a text less toxic."""

    def __init__(self, hidden: int = 8, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"W": r.uniform(0, 0.5, (len(LEVELS), hidden)), "b": r.normal(0, 0.5, hidden), "c": r.uniform(0, 1, hidden), "d": np.zeros(1)}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"]) @ self.p["c"] + self.p["d"]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        dh = slope[:, None] * self.p["c"] * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "c": h.T @ slope, "d": slope.sum(keepdims=True)}

    def fit(self, toxic: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, batch: int = 512, rate: float = 0.03, decay: float = 1e-4, seed: int = 0) -> Classifier:
        """Adam; each step draws as many of either side, with repeats."""
        r = np.random.default_rng(seed)
        self.p["d"][:] = np.log(prior / (1 - prior))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            p, u = toxic[r.integers(0, len(toxic), batch)], unlabelled[r.integers(0, len(unlabelled), batch)]
            to_p, to_u = slopes(self.logits(p), self.logits(u), prior)
            one, two = self.gradient(p, to_p), self.gradient(u, to_u)
            for k in self.p:
                g = one[k] + two[k] + decay * self.p[k] * (k in "Wc")
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k in "Wc":
                    self.p[k] = np.maximum(self.p[k], 0)
        return self


class Model:
    """How telling each bucket is, and the networks."""

    def __init__(self, tells: np.ndarray, members: list[Classifier]):
        self.tells, self.members = tells, members

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.mean([_sigmoid(c.logits(x)) for c in self.members], axis=0) if len(x) else np.zeros(0)


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """toxic, unlabelled: bags. Of each fold the densities are taken by the counts of the others."""
    p, u = Counts(), Counts()
    for side, bags in ((p, toxic), (u, unlabelled)):
        for one in bags:
            side.add(one)
    x = [np.zeros((len(bags), len(LEVELS))) for bags in (toxic, unlabelled)]
    for k in range(FOLDS):
        for sign in (-1, 1):
            for side, bags in ((p, toxic), (u, unlabelled)):
                for one in bags[k::FOLDS]:
                    side.add(one, sign)
            if sign < 0:
                tells = telling(p, u)
                for at, bags in zip(x, (toxic, unlabelled), strict=True):
                    for i in range(k, len(bags), FOLDS):
                        at[i] = described(bags[i][:, 0], tells[bags[i][:, 1:]].max(1, initial=-9))
    return Model(telling(p, u), [Classifier(seed=s).fit(*x, prior, seed=s) for s in range(MEMBERS)])


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1500, unlabelled: int = 3000, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learns from at most `toxic` documents labelled 1 and `unlabelled` others, both the least by a hash of their ids and not held out.

    prior: the share of toxic documents; by default that among the labels learnt from, or `PRIOR` if none of them is 0. Rows
    without an id or a label are left out, of several labels for an id the largest holds, and of several texts for an id
    that with the least hash is read. Without a confirmed document nothing can be learnt: None, by which every score is 0,
    and a warning is logged.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    share = known.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    prior = min(0.9, max(0.001, prior if prior is not None else share if share and share < 1 else PRIOR))
    confirmed = known.filter("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(toxic).select("_id", F.lit(True).alias("_p"))
    # Of all ids those whose hash is low enough for some eight times as many as are wanted; each once, then the least.
    part = min(1.0, 8 * unlabelled / max(1, docs.count()))
    low = docs.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull() & ~held_out("_id") & (F.shiftrightunsigned(F.xxhash64("_id"), 33) <= int(part * 2**31)))
    others = low.distinct().orderBy(F.xxhash64("_id"), "_id").limit(unlabelled).select("_id", F.lit(True).alias("_u"))
    # At most toxic + unlabelled rows, so small enough to broadcast.
    chosen = confirmed.join(others, "_id", "full")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    one = texts.groupBy("_id", "_p", "_u").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = []
            for t in batch.column(3).to_pylist():
                b = bag(t)
                b = b[np.argsort(b[:, 1], kind="stable")]
                found.append(b[np.linspace(0, len(b) - 1, min(len(b), TRAIN_WORDS)).astype(int)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["_id", "_p", "_u", "bag"])

    found = sorted((r["_id"], r["_p"], r["_u"], bytes(r["bag"])) for r in one.mapInArrow(bags, "_id string, _p boolean, _u boolean, bag binary").toLocalIterator())
    read = lambda b: np.frombuffer(b, np.int32).reshape(-1, 2 + len(BEGINNINGS))
    p, u = [read(b) for _, is_p, _, b in found if is_p], [read(b) for _, _, is_u, b in found if is_u]
    if not p or not u:
        _log.warning("no document is confirmed as toxic: nothing is learnt")
        return None
    return fit(p, u, prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold on).

    Without a model every score is 0. Null and empty texts have no words and get the least score. Null ids and repeated rows
    are passed on as they are. No column but the text bears on the score, and no other than the two named is read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[bytes, int] = {}
        edges = LEVELS.tolist()
        for batch in sliced(batches):
            x = np.zeros((len(batch), len(LEVELS)))
            for i, t in enumerate(batch.column(2).to_pylist() if model else ()):
                held, total = [0] * (len(LEVELS) + 1), 0
                for w, n in Counter(words(t)).items():
                    at = levels.get(w)
                    if at is None:
                        if len(levels) >= _KEPT:
                            levels.clear()
                        at = levels[w] = bisect_right(edges, float(model.tells[features(w)].max()))
                    held[at] += n
                    total += n
                x[i] = densities(np.array(held), total)
            scores = model.scores(x) if model else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, toxic: int = 1500, unlabelled: int = 3000) -> DataFrame:
    """Learns from the labels and scores all of docs."""
    return score(docs, train(docs, labels, toxic, unlabelled))

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), the pairwise
part in linear time by the sum-of-squares identity.  Inputs are the length-normalised counts of
hashed words and, one of eight quantile classes each, statistics of the text's structure (shares
of character kinds, word and sentence lengths, repetition) and its length in bytes as metadata.

The model is fitted on a bounded sample of labelled documents (``sample_docs``); scoring reads
every whole text.  Defined results: null is the empty text, which has statistics like any other
text and so a score; null labels are left out, conflicting ones count as good; rows pass one to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .hashing import hashed_words
from .toxicity import labelled_sample

WORD_BITS = 14
CLASSES = 8
STATS = 16
SIZE = (1 << WORD_BITS) + STATS * CLASSES
_KINDS = [b" ", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"%*$#&", b"!", b"|", b".,;:?", bytes(range(128, 256))]


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics (texts x STATS), and the distinct hashed words as (text, bucket, value)."""
    n = len(texts)
    stats = np.zeros((n, STATS))
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
        count = np.bincount(raw, minlength=256)
        size = max(1, len(raw))
        stats[i, : len(_KINDS)] = [count[list(k)].sum() / size for k in _KINDS]
        stats[i, 10] = np.log1p(len(raw))
        stats[i, 11] = count.max() / size
    h, sentence, text = hashed_words(texts)
    words = np.bincount(text, minlength=n)
    key = np.unique(text.astype(np.int64) << 32 | h[:, 0].astype(np.int64))
    kinds = np.bincount(key >> 32, minlength=n)
    first = np.flatnonzero(np.diff(sentence, prepend=-1)) if len(sentence) else np.zeros(0, np.int64)
    sentences = np.bincount(text[first], minlength=n)
    stats[:, 12] = np.log1p(words)
    stats[:, 13] = kinds / np.maximum(1, words)
    stats[:, 14] = words / np.maximum(1, sentences)
    stats[:, 15] = np.expm1(stats[:, 10]) / np.maximum(1, words)
    bucket, tf = np.unique(text.astype(np.int64) << WORD_BITS | (h[:, 0] & ((1 << WORD_BITS) - 1)), return_counts=True)
    text = bucket >> WORD_BITS
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(text, value**2, minlength=n))
    return stats, text, bucket & ((1 << WORD_BITS) - 1), value / norm[text]


@dataclass
class Model:
    edges: np.ndarray  # STATS x (CLASSES - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def one_hot(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the statistics' classes."""
        cls = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, stats.T)], axis=1)
        return (1 << WORD_BITS) + np.arange(STATS) * CLASSES + cls

    def scores(self, texts: list[str | None]) -> np.ndarray:
        n = len(texts)
        stats, text, bucket, value = measure(texts)
        hot = self.one_hot(stats)
        total = self.bias + self.linear[hot].sum(1) + np.bincount(text, self.linear[bucket] * value, minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f]
            part = v[bucket] * value
            own = v[hot]
            plain = own.sum(1) + np.bincount(text, part, minlength=n)
            total += 0.5 * (plain**2 - (own**2).sum(1) - np.bincount(text, part**2, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def fit_arrays(stats: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 4, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """AdaGrad on the logistic loss, one document at a time in a fixed shuffled order."""
    edges = np.quantile(stats, np.arange(1, CLASSES) / CLASSES, axis=0).T if len(stats) else np.zeros((STATS, CLASSES - 1))
    rng = np.random.default_rng(7)
    model = Model(edges, 0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, rank)))
    if not len(labels):
        return model
    hot = model.one_hot(stats)
    docs = [(np.concatenate([hot[i], b]), np.concatenate([np.ones(STATS), x])) for i, (b, x) in enumerate(rows)]
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    w, v = model.linear, model.factors
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, x = docs[i]
            vx = v[ids] * x[:, None]
            s = vx.sum(0)
            z = model.bias + w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum())
            g = 1.0 / (1.0 + np.exp(-z)) - labels[i]
            dw = g * x + decay * w[ids]
            dv = g * x[:, None] * (s - vx) + decay * v[ids]
            gb += g * g
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            model.bias -= rate * g / np.sqrt(gb)
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on documents of docs with a label, held-out ids excepted."""
    sample = labelled_sample(docs.select(id_col, text_col), labels, label, sample_docs, id_col).select("_label", F.xxhash64(id_col).alias("_order"), text_col)

    def features(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                stats, _, bucket, value = measure([t])
                out.append((stats.tobytes(), bucket.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), pa.binary()) for c in cols)], ["label", "order", "stats", "bucket", "value"])

    rows = sorted(sample.mapInArrow(features, "label int, order long, stats binary, bucket binary, value binary").collect(), key=lambda r: (r.order, r.stats, r.bucket))
    stats = np.array([np.frombuffer(r.stats) for r in rows]).reshape(-1, STATS)
    words = [(np.frombuffer(r.bucket, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float)) for r in rows]
    return fit_arrays(stats, words, np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [shared.value.scores(texts[lo:hi]) for lo, hi in chunks(texts)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")

"""Toxicity by multiple-instance learning: sentences are instances, documents carry the labels.

A sentence's score is the logistic of a bias and the weights of its hashed words and word
stems; a document's score is the noisy-or of its sentences, 1 - prod(1 - p).  A fitted model counts
only what a sentence's words add to the bias, (1 - p) / (1 - p of the bias alone), so sentences
without evidence add nothing, however many a text has.  Training maximises the likelihood of
document labels through the noisy-or, so the weights end up on the sentences that make a document
toxic; ``offending_sentences`` returns those sentences.

The model is fitted on a bounded sample of labelled documents (``sample_docs``, picked by a
hash of the id); scoring reads every whole text.  Defined results: null and empty texts have no
sentence and score 0; a document with conflicting labels counts as toxic; null labels are left
out; rows pass one to one; without any label of a kind the model is the bias alone and all score 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out
from .hashing import hashed_words

STEMS = (4, 6)


@dataclass
class Model:
    bits: int = 20
    bias: float = -9.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, np.float32))
    prior: bool = True  # whether sentences without evidence count, with the bias's probability

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the sentences and the text of each."""
        h, sentence, text = hashed_words(texts, STEMS)
        if not len(sentence):
            return np.zeros(0), np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        gain = self.weights[h & ((1 << self.bits) - 1)].sum(axis=1, dtype=np.float64)
        return self.bias + np.add.reduceat(gain, first), text[first]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z, text = self.sentences(texts)
        miss = np.logaddexp(0.0, z)
        if not self.prior:
            miss = np.maximum(miss - np.logaddexp(0.0, self.bias), 0.0)
        return -np.expm1(-np.bincount(text, miss, minlength=len(texts)))


def fit_arrays(bags: list[np.ndarray], labels: np.ndarray, bits: int = 20, min_docs: int = 3, min_lift: float = 3.0, rounds: int = 300) -> Model:
    """bags: per document a uint32 array (words, 1 + number of columns): sentence number, then hashes."""
    model = Model(bits, prior=False)
    model.weights = np.zeros(1 << bits, np.float32)
    toxic = labels.astype(bool)
    if not toxic.any() or toxic.all():
        return model
    mask = np.uint32((1 << bits) - 1)
    seen = np.zeros((2, 1 << bits), np.int32)
    for b, y in zip(bags, toxic):
        seen[int(y), np.unique(b[:, 1:] & mask)] += 1
    # only words that are clearly commoner in toxic documents can be evidence; all others keep weight 0
    lift = (seen[1] / toxic.sum()) / ((seen[0] + 0.5) / (~toxic).sum())
    chosen = np.flatnonzero((seen[1] >= min_docs) & (lift >= min_lift))
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    feature, owner, doc_of, n = [], [], [], 0
    for d, b in enumerate(bags):
        if not len(b):
            continue
        count = int(b[-1, 0]) + 1
        at = place[b[:, 1:] & mask]
        r, c = np.nonzero(at >= 0)
        feature.append(at[r, c])
        owner.append(b[r, 0].astype(np.int64) + n)
        doc_of.append(np.full(count, d))
        n += count
    feature, owner, doc_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (feature, owner, doc_of))
    theta, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    theta[-1] = model.bias
    weight = np.where(toxic, 4.0, 1.0)  # missing a toxic document costs more than a doubtful clean one
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(owner, theta[feature], minlength=n)
        miss = np.bincount(doc_of, np.logaddexp(0.0, z), minlength=len(bags))  # -log of the chance of no toxic sentence
        pull = np.where(toxic, -1.0 / np.expm1(np.maximum(miss, 1e-9)), 1.0) * weight
        g = pull[doc_of] / (1.0 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(feature, g[owner], minlength=len(chosen)) + 0.05 * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-1] = min(theta[-1], -7.0)  # the words and not the bias explain toxic documents
    model.bias = float(theta[-1])
    model.weights[chosen] = theta[:-1]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label, text columns of docs) of at most ``sample_docs`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    picked = known.groupBy(id_col).agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    return docs.join(F.broadcast(picked), id_col)  # sample_docs rows of two numbers at most


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on documents of docs with a label, held-out ids excepted."""
    sample = labelled_sample(docs.select(id_col, text_col), labels, label, sample_docs, id_col).select("_label", F.xxhash64(id_col).alias("_order"), text_col)

    def bags(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                h, sentence, _ = hashed_words([t], STEMS)
                out.append(np.column_stack([sentence, h]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["label", "order", "bag"])

    rows = sorted(sample.mapInArrow(bags, "label int, order long, bag binary").collect(), key=lambda r: (r.order, r.bag))
    width = 2 + len(STEMS)
    return fit_arrays([np.frombuffer(r.bag, "<u4").reshape(-1, width) for r in rows], np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
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


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, sentence, score): the sentences whose own score reaches the threshold, numbered from 0 among those with words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                z, text = shared.value.sentences(texts[lo:hi])
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                number = np.arange(len(z)) - np.searchsorted(text, text)
                hit = np.flatnonzero(p >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[hit] + lo)), pa.array(number[hit].astype(np.int32)), pa.array(p[hit])], [id_col, "sentence", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, sentence int, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            got = [shared.value.scores(texts[lo:hi]) for lo, hi in chunks(texts)]
            yield b.filter(pa.array((np.concatenate(got) if got else np.zeros(0)) < threshold))

    return docs.mapInArrow(run, docs.schema)

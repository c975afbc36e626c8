"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of terms (words, hashed into ``TERMS`` counters) and of byte-class pairs (letters,
digits, blanks and marks by class, for what terms don't show), with three measures of repetition.
Weighting by inverse document frequency and a truncated singular value decomposition, both learned from
labelled texts, turn them into short unit vectors. The labelled vectors (at most ``max_labelled``, a
fixed bound) are broadcast, and each document's exact cosine with every one of them is computed block by
block; the ``neighbours`` nearest vote with weight similarity ** ``SHARPNESS``.

Learning takes at most ``max_labelled`` labelled rows, half of them from each label where there are
enough, chosen by a hash of the doc_id; scoring covers every row in one map, without a shuffle.

Defined cases: a null, empty or blank text scores 0; rows without a 0/1 label are not learned from;
repeated rows of one doc_id and label are learned from once; with no usable labelled row every text scores 0.5;
ties among neighbours are broken by the order of (label, doc_id); very long texts are counted whole; an
empty table gives no rows; other columns are carried along, one named ``score`` gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .shingles import word_hashes

MAX_LABELLED = 4000
DIMENSIONS = 64
#: Counters for hashed words (at most 65535), and their weight against the byte-class pairs.
TERMS, TERM_WEIGHT = 4096, 0.5
#: The power of the similarity that a vote weighs.
SHARPNESS = 8
NEIGHBOURS = 15
#: Documents and labelled vectors that meet in one matrix product.
DOC_BLOCK, LABEL_BLOCK = 256, 1000
#: Extra features besides the pairs of byte classes.
EXTRAS = 3


def _classes() -> np.ndarray:
    """A class for each byte: lower case, upper case, digits, high bytes, other controls, then blanks and marks."""
    out = np.full(256, 4, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[128:] = 3
    for k, same in enumerate([" ", "\n", "\t\r", ".", ",", ";:", "!", "?", "'\"`", "()[]{}", "-_", "/\\", "|", "#", "*", "$", "%", "&", "<", ">", "=+", "@", "^~"]):
        for c in same:
            out[ord(c)] = 5 + k
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
PAIRS = N_CLASSES * N_CLASSES
#: Columns: pairs, extras, terms.
WIDTH = PAIRS + EXTRAS + TERMS


def _repetition(text: bytes) -> tuple[float, float, float]:
    """Shares of words equal to the one before, of word pairs seen before, of lines seen before."""
    words = text.split()
    if not words:
        return 0.0, 0.0, 0.0
    nexts = words[1:]
    rows = [x for x in text.split(b"\n") if x]
    pairs = max(1, len(nexts))
    return sum(map(eq, words, nexts)) / pairs, 1 - len(set(zip(words, nexts))) / pairs if nexts else 0.0, 1 - len(set(rows)) / max(1, len(rows))


def features(texts: list[bytes]) -> np.ndarray:
    """A row per text: square roots of pair shares, the extras, square roots of term shares. Blank texts
    are zero rows."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        if not text.strip():
            continue
        c = CLASSES[np.frombuffer(text, np.uint8)]
        if len(c) > 1:
            n = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=PAIRS)
            out[k, :PAIRS] = np.sqrt(n / (len(c) - 1))
        out[k, PAIRS : PAIRS + EXTRAS] = _repetition(text)
        words = word_hashes(text)
        n = np.bincount((words & np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
        out[k, PAIRS + EXTRAS :] = np.sqrt(n / len(words))
    return out


def _squeeze(row: np.ndarray) -> bytes:
    """The places and half-precision values that aren't zero."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f2").tobytes()


def _spread(row: bytes) -> np.ndarray:
    out, half = np.zeros(WIDTH, np.float32), len(row) // 2
    out[np.frombuffer(row[:half], "<u2")] = np.frombuffer(row[half:], "<f2")
    return out


def basis(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The first right singular vectors of ``x``, as columns (zero beyond its rank), by subspace iteration
    from a fixed start; each one's largest part is positive."""
    n = min(dimensions, *x.shape)
    out = np.zeros((x.shape[1], dimensions), np.float32)
    if n:
        q = np.random.default_rng(1).standard_normal((x.shape[1], min(n + 16, *x.shape))).astype(np.float32)
        for _ in range(8):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, found, v = np.linalg.svd(x @ q, full_matrices=False)
        v = (q @ v.T)[:, :n] * (found[:n] > 1e-6 * max(1e-12, found[0]))
        out[:, :n] = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1, 1)
    return out


@dataclass
class Model:
    """Weights, projection, and the labelled vectors with their labels."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.weights) @ self.projection
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.maximum(norm, 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        q, k = self.project(rows), min(self.neighbours, len(self.labels))
        best = np.full((len(q), 0), 0.0, np.float32)
        labels = np.zeros((len(q), 0), np.float32)
        for at in range(0, len(self.labels), LABEL_BLOCK):  # the best of the blocks so far and of this one
            best = np.hstack([best, q @ self.vectors[at : at + LABEL_BLOCK].T])
            labels = np.hstack([labels, np.broadcast_to(self.labels[at : at + LABEL_BLOCK], (len(q), len(self.labels[at : at + LABEL_BLOCK])))])
            if best.shape[1] > k:
                top = np.sort(np.argpartition(-best, k - 1, axis=1)[:, :k], axis=1)
                best, labels = np.take_along_axis(best, top, 1), np.take_along_axis(labels, top, 1)
        weight = np.maximum(best, 0).astype(np.float64) ** SHARPNESS + 1e-9
        score = (weight * labels).sum(1) / weight.sum(1)
        score[~rows.any(axis=1)] = 0.0
        return score


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most ``max_labelled`` rows of ``labels`` (doc_id, label) and their texts.

    The rows are chosen among the labels alone; only the chosen ids meet the documents, as a
    broadcast of that fixed bound, so the texts are scanned but not shuffled."""
    half = max_labelled // 2
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_BLOCK):
                part = batch.slice(at, DOC_BLOCK)
                found = features([x or b"" for x in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(2), pa.array(map(_squeeze, found), pa.binary())], ["doc_id", "label", "row"])

    chosen = [marks.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for value in (0, 1)]
    few = chosen[0].union(chosen[1]).collect()  # at most max_labelled pairs
    small = docs.sparkSession.createDataFrame([tuple(r) for r in few], "doc_id long, label int")
    got = scratch.map_arrow(texts.join(F.broadcast(small), "doc_id").select("doc_id", "text", "label"), extract, "doc_id long, label int, row binary")
    # a doc_id that many rows repeat counts once for each label row: the result stays bounded
    got = sorted(got.groupBy("doc_id", "label").agg(F.min("row").alias("row")).collect(), key=lambda r: (r.label, r.doc_id))
    vectors, targets = [bytes(r.row) for r in got], [r.label for r in got]
    x = np.stack([_spread(v) for v in vectors]) if vectors else np.zeros((0, WIDTH), np.float32)
    seen = x.any(axis=1)
    x, y = x[seen], np.array(targets, np.float32)[seen]
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weights[PAIRS : PAIRS + EXTRAS] = 1.0
    weights[PAIRS + EXTRAS :] *= np.float32(TERM_WEIGHT)
    model = Model(weights, basis(x * weights, dimensions), np.zeros((0, dimensions), np.float32), y, neighbours)
    model.vectors = model.project(x).astype(np.float32)
    return model


def scores(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text of ``docs`` as a column: nothing but the text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled, dimensions and WIDTH
    scratch.bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        try:
            for batch in batches:
                parts = [m.score(features([x or b"" for x in batch.slice(at, DOC_BLOCK).to_pylist()])) for at in range(0, len(batch), DOC_BLOCK)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        finally:
            scratch.give_back()

    return score_of(text.cast("string").cast("binary"))


def score(docs: DataFrame, model: Model, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` (columns of ``docs``, other than score) and ``score``, a row per document."""
    return docs.select(*keep, scores(docs, model, text).alias("score"))

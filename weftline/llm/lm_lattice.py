"""Language-model scores from a subword lattice.

The pieces of a public vocabulary file are the arcs of a lattice over each word (a blank, then the
word's bytes); every single byte is an arc too, so any word can be spelled. A forward recursion in
log space sums over all segmentations and gives the word's marginal probability; a text's is the
product over its words and one end piece. No piece holds a blank but at its start, so the words'
lattices are independent and each distinct word is worked out once. Words of any length are summed over
whole; a very long one holds 16 bytes a byte, and its arcs by stretches.

The file's own piece scores are merge ranks, not probabilities: they set the order of the starting
weights, 1 / (1 + rank), and expectation-maximisation over all distinct training words (forward and
backward sums, weighted by count) turns them into unigram log probabilities.

Work over the corpus: one pass counts words (partial counts per task, then a shuffle by word), each
EM round is a map over the distinct words with an aggregation by piece, and a last pass scores the
documents. The most frequent words, at most ``HEAD``, are broadcast; a document's other words
join the table of word scores by key and are summed per document. No step gathers words or documents.

Words are runs of anything but the blanks 0x20 and 0x09-0x0D, in lower case A-Z.

Defined cases: a null or empty text is the end token alone; repeated rows and repeated or null
doc_ids are scored row by row; without training texts every token is unknown and the starting
weights stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

EM_ROUNDS = 3
#: Added to each piece's expected count.
SMOOTHING = 0.1
#: Words whose scores are broadcast, and their greatest length in bytes.
HEAD, HEAD_BYTES = 1 << 18, 40
#: Distinct words held by a task before it passes its counts on.
TASK_WORDS = 400_000
#: Words that go through the recursion together.
BLOCK = 8192
#: Start places whose arcs are held at once; words of any length are summed over whole.
STRETCH = 256
LN10 = float(np.log(10))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; ``bytes`` methods know ASCII alone, as the definition does."""
    return text.lower().split()


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes and the ids that they stand for; the end piece is the last id. Of each
    length also the sorted hashes of what pieces begin with, and the ids of those that are pieces (else -1)."""

    hashes: list[np.ndarray]
    ids: list[np.ndarray]
    size: int
    start: np.ndarray
    prefixes: list[np.ndarray]
    prefix_ids: list[np.ndarray]

    @property
    def end(self) -> int:
        return self.size - 1


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(rows.shape[0], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h = h * _FACTOR + (rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


_WORKER: dict[str, Vocabulary] = {}


def worker_vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and file."""
    if path not in _WORKER:
        _WORKER[path] = load_vocabulary(path)
    return _WORKER[path]


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece file that lower-case words can hold, and all single bytes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, int] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        b = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in b[1:] and b == b.lower() and not any(c in b for c in b"\t\n\x0b\x0c\r"):
            pieces.setdefault(b, len(pieces))
    for b in range(256):
        pieces.setdefault(bytes([b]), len(pieces))
    longest = max(map(len, pieces))
    hashes, ids = [], []
    for n in range(1, longest + 1):
        own = [(p, i) for p, i in pieces.items() if len(p) == n]
        if own:
            h = _hash(np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, n))
            order = np.argsort(h)
            hashes.append(h[order])
            ids.append(np.array([i for _, i in own])[order])
        else:
            hashes.append(np.zeros(0, np.uint64))
            ids.append(np.zeros(0, np.int64))
    weight = 1 / (1 + np.arange(len(pieces) + 1, dtype=np.float64))
    prefixes, prefix_ids = [], []
    for n in range(1, longest + 1):
        own = sorted({p[:n] for p in pieces if len(p) >= n})
        h = _hash(np.frombuffer(b"".join(own), np.uint8).reshape(-1, n))
        order = np.argsort(h)
        prefixes.append(h[order])
        prefix_ids.append(np.array([pieces.get(p, -1) for p in own])[order])
    return Vocabulary(hashes, ids, len(pieces) + 1, np.log(weight / weight.sum()), prefixes, prefix_ids)


def _arcs(v: Vocabulary, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece length (from 1) where pieces start (place * words + word, ascending) and their ids.
    ``places``: a row of the words' bytes per place. A start is followed as long as some piece goes on so."""
    n, flat = places.shape[1], places.ravel().astype(np.uint64) + np.uint64(1)
    at, h, out = np.arange(len(flat)), np.zeros(len(flat), np.uint64), []
    for k, (keys, ids) in enumerate(zip(v.prefixes, v.prefix_ids, strict=True)):
        inside = int(np.searchsorted(at, len(flat) - k * n))
        if not inside:
            break
        at = at[:inside]
        with np.errstate(over="ignore"):
            h = h[:inside] * _FACTOR + flat[at + k * n]
        found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        on = keys[found] == h
        at, h, found = at[on], h[on], ids[found[on]]
        piece = found >= 0
        out.append((at[piece], found[piece]))
    return out


def _stretches(v: Vocabulary, places: np.ndarray, back: bool = False) -> Iterator[tuple[int, list[tuple]]]:
    """Arcs for ``STRETCH`` start places at a time, from the first or (``back``) the last stretch on; per piece
    length the words, the ids, and where each start place's begin. Arcs that pass a stretch's end are
    among them."""
    length, n = places.shape
    starts = range(0, length, STRETCH)
    for s in reversed(starts) if back else starts:
        m, out = min(STRETCH, length - s), []
        for at, ids in _arcs(v, places[s : s + STRETCH + len(v.prefixes) - 1]):
            bounds = np.searchsorted(at, np.arange(m + 1) * n)
            out.append((at[: bounds[-1]] % n, ids, bounds.tolist()))
        yield s, out


def _at_once(v: Vocabulary, places: np.ndarray) -> list | None:
    """All arcs of words of one stretch, to be used twice."""
    return list(_stretches(v, places)) if len(places) <= STRETCH else None


def forward(v: Vocabulary, logp: np.ndarray, places: np.ndarray, arcs: list | None = None) -> np.ndarray:
    """Log of the summed weight of all ways to each place; the last row is the marginal."""
    length, n = places.shape
    alpha = np.full((length + 1, n), -np.inf)
    alpha[0] = 0
    for s, by_length in arcs if arcs is not None else _stretches(v, places):
        for i in range(s, min(s + STRETCH, length)):
            for k, (words, ids, bounds) in enumerate(by_length, 1):
                lo, hi = bounds[i - s], bounds[i - s + 1]
                if lo < hi:
                    w = words[lo:hi]
                    alpha[i + k, w] = np.logaddexp(alpha[i + k, w], alpha[i, w] + logp[ids[lo:hi]])
    return alpha


def expected(v: Vocabulary, logp: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the words, weighted by ``counts``."""
    length, n = places.shape
    arcs = _at_once(v, places)
    alpha = forward(v, logp, places, arcs)
    beta = np.full((length + 1, n), -np.inf)
    beta[length] = 0
    out = np.zeros(v.size)
    for s, by_length in arcs if arcs is not None else _stretches(v, places, back=True):
        used, shares = [], []
        for i in range(min(s + STRETCH, length) - 1, s - 1, -1):
            for k, (words, ids, bounds) in enumerate(by_length, 1):
                lo, hi = bounds[i - s], bounds[i - s + 1]
                if lo < hi:
                    w = words[lo:hi]
                    step = logp[ids[lo:hi]] + beta[i + k, w]
                    beta[i, w] = np.logaddexp(beta[i, w], step)
                    used.append(ids[lo:hi])
                    shares.append(np.exp(alpha[i, w] + step - alpha[length, w]) * counts[w])
        if used:
            out += np.bincount(np.concatenate(used), np.concatenate(shares), minlength=v.size)
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of equal length: which words, and by place a row of their bytes (a blank first)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        block = max(1, BLOCK * 16 // (int(n) + 1))
        for at in range(0, len(which), block):
            part = which[at : at + block]
            rows = np.frombuffer(b"".join([b" " + words[i] for i in part]), np.uint8).reshape(len(part), n + 1)
            yield part, np.ascontiguousarray(rows.T)


def word_log10(v: Vocabulary, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log10 of each word's marginal probability."""
    out = np.zeros(len(words))
    for part, rows in _by_length(words):
        out[part] = forward(v, logp, rows)[-1] / LN10
    return out


def word_expected(v: Vocabulary, logp: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    out = np.zeros(v.size)
    for part, rows in _by_length(words):
        out += expected(v, logp, rows, counts[part])
    return out


def count_words(docs: DataFrame, doc_id: Column, text: Column, held_out: Column) -> DataFrame:
    """``word, c``: every distinct word of all texts with its count in those not held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        other: set[bytes] = set()

        def rows() -> Iterator[pa.RecordBatch]:
            words = [*train, *(other - train.keys())]
            counts = np.zeros(len(words), np.int64)
            counts[: len(train)] = np.fromiter(train.values(), np.int64, len(train))
            for at in range(0, len(words), 50_000):
                yield pa.record_batch([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000])], ["word", "c"])
            train.clear()
            other.clear()

        for batch in batches:
            for held, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(value.as_py() or b"")
                if held:
                    other.update(found)
                else:
                    train.update(found)
                if len(train) + len(other) > TASK_WORDS:
                    yield from rows()
        yield from rows()

    picked = docs.select(F.coalesce(held_out, F.lit(False)).alias("held"), text.cast("string").cast("binary").alias("text"))
    return scratch.map_arrow(picked, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Piece log probabilities, the words' table (word, c, lp) and the base's totals."""

    logp: np.ndarray
    words: DataFrame
    n: int
    v: int
    end_count: int


def fit(docs: DataFrame, vocabulary: str, doc_id: Column, text: Column, held_out: Column, rounds: int = EM_ROUNDS) -> Model:
    """Learn piece probabilities from the texts that are not held out."""
    spark = docs.sparkSession
    counted = scratch.save(count_words(docs, doc_id, text, held_out), "words")
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).head()
    ends = docs.where(~F.coalesce(held_out, F.lit(False))).count()
    voc = load_vocabulary(vocabulary)
    logp = voc.start
    for _ in range(rounds if total.n else 0):
        weights = spark.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            v, found = worker_vocabulary(vocabulary), 0.0
            for batch in batches:
                found = found + word_expected(v, weights.value, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            if not np.isscalar(found):
                used = np.flatnonzero(found)
                yield pa.record_batch([pa.array(used), pa.array(found[used])], ["piece", "e"])

        sums = scratch.map_arrow(counted.where("c > 0"), expect, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        e = np.full(voc.size, SMOOTHING)  # at most a row per piece
        for r in sums:
            e[r.piece] += r.e
        e[voc.end] += ends
        logp = np.log(e / e.sum())

    final = spark.sparkContext.broadcast(logp)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = worker_vocabulary(vocabulary)
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(word_log10(v, final.value, batch.column(0).to_pylist()))], ["word", "c", "lp"])

    words = scratch.save(scratch.map_arrow(counted, finish, "word binary, c long, lp double"), "word-scores")
    return Model(logp, words, int(total.n) + ends, int(total.v) + (ends > 0), ends)


def _head(words: DataFrame) -> DataFrame:
    """The most frequent words, at most HEAD: all those in the upper count classes that fit whole.
    Only the classes' sizes (16 a power of two) come to the driver; nothing is sorted in one task."""
    short = words.where((F.col("c") > 0) & (F.octet_length("word") <= HEAD_BYTES)).withColumn("class", F.floor(16 * F.log2("c")).cast("int"))
    cut, total = 1 << 20, 0
    for r in sorted(short.groupBy("class").count().collect(), reverse=True):
        total += r[1]
        if total > HEAD:
            break
        cut = r[0]
    return short.where(F.col("class") >= cut).drop("class")


def score(docs: DataFrame, model: Model, doc_id: Column, text: Column, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    spark = docs.sparkSession
    head = _head(model.words)
    floor = model.n + 0.1 * (model.v + 1)
    known = {bytes(r.word): (float(np.log10((r.c + 0.1) / floor)), r.lp) for r in head.toLocalIterator()}
    held = spark.sparkContext.broadcast(known)
    end_base, end_score, end_known = float(np.log10((model.end_count + 0.1) / floor)), float(model.logp[-1]) / LN10, int(model.end_count > 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = held.value, TaskContext.get().partitionId() << 40
        names = ["row", "word", "n", "doc_id", "held", "n_tokens", "n_known", "base", "score"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            for key, is_held, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = tokens(value.as_py() or b"")
                row += 1
                n_known, base, total, rest = end_known, end_base, end_score, []
                for word, n in Counter(found).items():
                    e = table.get(word)
                    if e is None:
                        rest.append((word, n))
                    else:
                        n_known += n
                        base += n * e[0]
                        total += n * e[1]
                # the document's own sums ride on its first row; a key with a blank meets no word
                rest = rest or [(b" %d" % row, 0)]
                k = len(rest)
                columns[0] += [row] * k
                columns[1] += [w for w, _ in rest]
                columns[2] += [n for _, n in rest]
                for c, first in zip(columns[3:], (key, is_held, len(found) + 1, n_known, base, total), strict=True):
                    c.append(first)
                    c += [None] * (k - 1)
                if len(columns[0]) >= 50_000:
                    yield flush()
        if columns[0]:
            yield flush()

    picked = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text.cast("string").cast("binary").alias("text"))
    rows = scratch.map_arrow(picked, look, "row long, word binary, n long, doc_id long, held boolean, n_tokens long, n_known long, base double, score double")
    joined = rows.join(model.words, "word", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    parts = joined.select(
        "row", "doc_id", "held", "n_tokens",
        (F.coalesce("n_known", F.lit(0)) + F.when(c > 0, n).otherwise(0)).alias("k"),
        (F.coalesce("base", F.lit(0.0)) + n * F.log10((c + 0.1) / F.lit(floor))).alias("b"),
        (F.coalesce("score", F.lit(0.0)) + n * F.coalesce("lp", F.lit(0.0))).alias("s"),
    )
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")

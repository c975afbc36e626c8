"""Repeated passages: MinHash banding over paragraphs, exact checks, removals by component.

A paragraph is a window of ``WORDS`` words (``WORDS - 4`` five-word shingles), at every place of a
text, so a passage is found wherever it stands in a line. A band is ROWS min-hashes of a window;
windows that are equal agree on every band, and as neighbouring windows mostly agree too, only runs
of windows are kept in which a band's value stays the same (at most a window's length). BANDS
bands find a window at Jaccard 0.8 with 1 - (1 - 0.8**ROWS)**BANDS = 0.9997.

A document whose whole text a smaller doc_id has too is one span, and goes no further.

Paragraphs that collide are compared with the first one of their band value (a star, never all
pairs), aligned at the shingle that gives the first min-hash: along that diagonal, windows at which at
least ``PERCENT`` of the union of shingles agree are a repeat, cut back to words inside agreeing
shingles.
Windows of a run that aren't equal to the leader's at their own place meet others again, under keys at
which a check can't fail, if their value has more rows than the leader's and theirs. Two windows pass it if at most ``_STRAY`` = SIZE shingles differ, so either
they share a run of _N - SIZE shingles, or one word alone differs inside: they agree on ``m`` shingles
before and _N - SIZE - m after it. There is a key for each such run, and one for each such word and ``m``
where some document has another word there between the same neighbours, and some window there failed
its check (windows that both pass with a leader are linked by it). So of windows that share a band value
no link is lost, whoever leads (the leader's other places meet again too).
Before that, those that can't pass with any other go: two windows that pass agree on all shingles from place
SIZE to _LONG, or on as many on the right, so also on the one run of RUN shingles that is chosen in such a part
by its value. Only windows with a chosen run that another document with the same leader has too, and where some window
failed its check, are given keys, each document's once for all its leaders.

The copy in the document with the smallest doc_id stays; the later ones are removals, and documents
that share passages form a component. A span that repeats in several documents names the smallest.

Defined cases: null, empty and short texts (under WORDS words) hold no paragraph; a passage that
repeats only inside one document is left alone; rows of one doc_id are one document; a null doc_id is
ignored; an empty table gives no rows; other columns are carried through ``cut`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hot, scratch
from .components import connected_components
from .shingles import SIZE, Block, blocks, mix, rolling

WORDS = 50
PERCENT = 80
BANDS, ROWS = 8, 2
#: Shingles on either side of a collision that are compared at first; a repeat that reaches further is followed.
NEAR = 1024
#: Bands that are dealt together.
_HALVES = (range(0, BANDS // 2), range(BANDS // 2, BANDS))
BROADCAST_ROWS = 1_000_000
#: Windows whose min-hashes are worked out at once.
BLOCK = 1 << 15

_N = WORDS - SIZE + 1
#: Shingles in which two windows may differ. One word inside makes SIZE of them differ, two make more.
_STRAY = _N - -(-2 * PERCENT * _N // (100 + PERCENT))
assert _STRAY == SIZE
#: Shingles on the longer side of a word that alone differs, at least.
_LONG = -(-(_N - SIZE) // 2)
#: Shingles in a run that stands for a part of a window, [SIZE, _LONG) or as far from its other end.
RUN = 12
assert RUN <= _LONG - SIZE
#: Odd factors: each orders all 64-bit values anew, by a bijection.
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(BANDS, ROWS) | np.uint64(1)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _lowest(h: np.ndarray) -> np.ndarray:
    """The least of each _N neighbours."""
    step = 1
    while 2 * step <= _N:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = _N - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _first(part: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Each window's least hash (32 bits) over the place of the leftmost shingle that has it."""
    with np.errstate(over="ignore"):
        return _lowest(part * seed & ~_LOW | np.arange(len(part), dtype=np.uint64))


def packed(at: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A run of ``length`` windows from ``start`` on that hold shingle ``at``; ordered by ``at``."""
    return at.astype(np.int64) << 12 | (at - start).astype(np.int64) << 6 | length.astype(np.int64)


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = run >> 12
    return at, at - (run >> 6 & 63), run & 63


def _pieces(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut to at most _N windows, as many as can share a shingle. Longer ones are of words that repeat at
    every few places."""
    n = -(-length // _N)
    part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + _N * part, np.minimum(_N, np.repeat(length, n) - _N * part)


def band_values(block: Block, bands: range = range(BANDS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of these bands (signed), for each the number of its text in the block, and its run of windows, around
    the leftmost shingle with the first min-hash in the run's first window."""
    keys, texts, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shingles, owner = rolling(block.words), np.repeat(np.arange(len(block)), np.diff(block.begin))
    inside = owner[: len(shingles) - _N + 1] == owner[WORDS - 1 :] if len(shingles) >= _N else np.zeros(0, bool)
    for at in range(0, len(inside), BLOCK):
        part, ok = shingles[at : at + BLOCK + _N - 1], inside[at : at + BLOCK]
        if not ok.any():
            continue
        for k in bands:
            rows = [_first(part, _SEEDS[k, 0])]
            with np.errstate(over="ignore"):
                rows += [_lowest((part * seed >> _HALF).astype(np.uint32)) for seed in _SEEDS[k, 1:]]
            change = np.ones(len(ok), bool)
            change[1:] = ok[1:] != ok[:-1]
            for x in (rows[0] & ~_LOW, *rows[1:]):
                change[1:] |= x[1:] != x[:-1]
            start = np.flatnonzero(change)
            length = np.append(start[1:], len(ok)) - start
            start, length = _pieces(start[ok[start]], length[ok[start]])
            first = rows[0][start]
            with np.errstate(over="ignore"):
                v = mix(np.uint64(k + 1) * _FACTOR + (first & ~_LOW))
                for x in rows[1:]:
                    v = mix(v * _FACTOR + x[start])
            text = owner[start + at]
            back = at - block.begin[text]
            keys.append(v)
            texts.append(text)
            runs.append(packed((first & _LOW).astype(np.int64) + back, start + back, length))
    keys, texts, runs = np.concatenate(keys), np.concatenate(texts), np.concatenate(runs)
    order = np.argsort(texts, kind="stable")  # neighbouring rows of one text take less room in a shuffle
    return keys[order].view(np.int64), texts[order], runs[order]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The powers 0 to ``n``, at least, of _BASE and _BACK."""
    if not _POWERS or len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(2 * n, 1 << 12), x, np.uint64))) for x in (_BASE, _BACK)]
    return _POWERS


def _sums(shingles: np.ndarray) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
    """Values of any runs of shingles, by their starts and lengths."""
    power, back = _powers(len(shingles))
    total = np.zeros(len(shingles) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(shingles * power[: len(shingles)], out=total[1:])
    return lambda at, n: (total[at + n] - total[at]) * back[at]


def _reached(windows: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which shingles stand ``low`` to ``high`` places after the start of one of the windows."""
    n = len(windows)
    total = np.zeros(n + 2 * high + 1, np.int64)
    np.cumsum(windows, out=total[high + 1 : high + 1 + n])
    total[high + 1 + n :] = total[high + n]
    return total[high - low + 1 :][: n + high] > total[: n + high]


def met_again(shingles: np.ndarray, left: np.ndarray, right: np.ndarray, failed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys for the windows that may be met by their ``left`` part, their ``right`` one or both, as columns ``key, run, other, failed``. A run of _N - SIZE shingles
    has a run and no ``other`` (``known`` is False). A word between a run of _LONG shingles and one shingle on its
    other side has, as its run, 2 * its first shingle + 1 if the long run is after it, and a value
    of the word as ``other``; ``failed`` tells whether a window there is marked so."""
    value, keys, runs, others, known, bad = _sums(shingles), [], [], [], [], []

    def add(key: np.ndarray, run: np.ndarray, other: np.ndarray, word: bool, some: np.ndarray) -> None:
        for into, x in ((keys, key), (runs, run), (others, other), (known, np.full(len(key), word)), (bad, some)):
            into.append(x)

    with np.errstate(over="ignore"):
        at = np.flatnonzero(_reached(left & right, 0, SIZE))  # such a run holds both parts
        add(mix(value(at, _N - SIZE)), packed(at, np.minimum(at, len(left) - 1), np.ones_like(at)), np.zeros(len(at), np.uint64), False, _reached(failed, 0, SIZE)[at])
        for after in (0, 1):
            low, high = (1, _LONG - 1) if after else (_LONG, _N - SIZE - 1)
            at = np.flatnonzero(_reached(right if after else left, low, high))
            long, one = (at + SIZE, at - 1) if after else (at - _LONG, at + SIZE)
            add(mix(mix(value(long, _LONG)) + shingles[one] * _FACTOR + np.uint64(after + 1)), 2 * at + after, shingles[at], True, _reached(failed, low, high)[at])
    return np.concatenate(keys).view(np.int64), np.concatenate(runs), np.concatenate(others).view(np.int64), np.concatenate(known), np.concatenate(bad)


def parts(shingles: np.ndarray, windows: np.ndarray, leader: int | np.ndarray) -> np.ndarray:
    """Two rows: for each of these windows (their starts) the least value of a run of RUN shingles in its left
    part and in its right one, mixed with the leader's node (or each window's own one's). Windows of two texts that share a
    band value, and so its leader, and pass the check have one of the two in common."""
    low = int(windows.min())
    own = shingles[low : int(windows.max()) + _N]
    values = mix(_sums(own)(np.arange(len(own) - RUN + 1), RUN))
    width = _LONG - SIZE - RUN + 1
    least = values[: len(values) - width + 1]
    for k in range(1, width):
        least = np.minimum(least, values[k : k + len(least)])
    at = windows - low
    with np.errstate(over="ignore"):
        return mix(np.stack([least[at + SIZE], least[at + _N - _LONG]]) + np.atleast_1d(np.asarray(leader, np.int64)).view(np.uint64) * _FACTOR).view(np.int64)


def part_keys(shingles: np.ndarray, unequal: np.ndarray, failed: np.ndarray, leader: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``parts`` of the windows marked ``unequal``, and for each whether one of them is marked ``failed``."""
    windows = np.flatnonzero(unequal)
    found = parts(shingles, windows, leader)
    keys, at = np.unique(found, return_inverse=True)
    bad = np.zeros(len(keys), bool)
    bad[at.reshape(found.shape)[:, failed[windows]]] = True
    return keys, bad


def around(shingles: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words as ``met_again`` gives them: a key for each window that holds one inside, without it, and its run."""
    before = np.arange(1, _N - SIZE)
    pairs = [(first, before[(before < _LONG) == side]) for side in (0, 1) for first in [words[words & 1 == side] >> 1]]
    m = np.concatenate([np.tile(n, len(first)) for first, n in pairs])
    start = np.concatenate([np.repeat(first, len(n)) for first, n in pairs]) - m
    inside = (start >= 0) & (start + _N <= len(shingles))
    start, m = start[inside], m[inside]
    value = _sums(shingles)
    with np.errstate(over="ignore"):
        keys = mix(mix(value(start, m)) * _FACTOR + value(start + m + SIZE, _N - SIZE - m) + m.astype(np.uint64))
    return keys.view(np.int64), packed(start + m - 1, start, np.ones_like(start))


def repeats(a: np.ndarray, b: np.ndarray, at: int, diagonal: int) -> tuple[list[tuple[int, int]], int, np.ndarray]:
    """Word spans of ``a`` around shingle ``at`` that repeat in ``b``, ``diagonal`` places before; the
    first window that was compared, and for it and each after it how many shingles are equal."""
    first, last = max(0, diagonal), min(len(a), len(b) + diagonal)
    lo, hi = max(first, at - NEAR), min(last, at + NEAR)
    while True:
        same = a[lo:hi] == b[lo - diagonal : hi - diagonal]
        if len(same) < _N:
            return [], lo, np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(same)])
        n = total[_N:] - total[:-_N]
        good = np.flatnonzero(n >= _N - _STRAY)
        if not len(good):
            return [], lo, n
        if (good[0] == 0 and lo > first) or (good[-1] == len(n) - 1 and hi < last):  # it goes on: look at all of it
            lo, hi = first, last
            continue
        inside = np.zeros(len(same) + 1, np.int64)
        np.add.at(inside, good, 1)
        np.add.at(inside, good + _N, -1)
        words = np.zeros(len(same) + SIZE + 1, np.int64)
        hits = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & same)
        np.add.at(words, hits, 1)
        np.add.at(words, hits + SIZE, -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(words) > 0).astype(np.int8), [0]]))
        return [(lo + int(s), lo + int(e)) for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)], lo, n


def _equal(own: np.ndarray, lead: np.ndarray, start: int, end: int, diagonal: int) -> tuple[int, np.ndarray]:
    """The first of these windows that the diagonal puts inside the leader, and for it and each after it
    whether they are equal."""
    s, e = max(start, diagonal), min(end + _N - 1, len(own), len(lead) + diagonal)
    total = np.concatenate([[0], np.cumsum(own[s:e] == lead[s - diagonal : e - diagonal])]) if s < e else np.zeros(1, np.int64)
    return s, total[_N:] - total[:-_N] == _N


def compare(own: np.ndarray, lead: np.ndarray, runs: np.ndarray, others: np.ndarray, several: np.ndarray, apart: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """For runs of one text and the leader's: the spans that repeat (none unless the texts are
    ``apart``), and for each window whether it was asked for in a run whose value has ``several`` others and isn't equal to one of the leader's, and whether it
    doesn't pass with any (all do unless ``apart``: they are the leader's). A window that is equal on a
    diagonal of other windows counts between two texts, as the leader then sends it on; inside one it doesn't."""
    spans = []
    size = max(0, len(own) - _N + 1)
    done = np.zeros(len(own) + SIZE, bool)
    equal, passed = np.zeros(size, bool), np.zeros(size, bool)
    ats, starts, lengths = unpacked(runs)
    others = others >> 12
    here = (ats < len(own)) & (others < len(lead))  # the rest are of another row with this doc_id
    if not here.all():
        ats, starts, lengths, others, several = (x[here] for x in (ats, starts, lengths, others, several))
    diagonals, ends = ats - others, starts + lengths
    asked = np.cumsum(np.bincount(np.minimum(starts[several], size), minlength=size + 1) - np.bincount(np.minimum(ends[several], size), minlength=size + 1))[:-1] > 0
    if not apart:
        for start, end, diagonal in zip(starts.tolist(), ends.tolist(), diagonals.tolist(), strict=True):
            if not equal[start:end].all():
                lo, whole = _equal(own, lead, start, end, diagonal)
                equal[lo : lo + len(whole)] |= whole
        return spans, asked & ~equal, np.zeros(size, bool)
    # runs by diagonal, in order, and where each diagonal's begin and end there
    order = np.argsort(diagonals, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, np.diff(diagonals[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    group = np.zeros(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    last = np.maximum(ats, ends - 1)
    left = bytearray(b"\1" * len(order))
    seen, edge = np.frombuffer(left, np.uint8), edge.tolist()
    for k, (at, start, end, diagonal, own_group) in enumerate(zip(ats.tolist(), starts.tolist(), ends.tolist(), diagonals.tolist(), group.tolist(), strict=True)):
        if not left[k] or equal[start:end].all():
            continue
        found, lo, n = repeats(own, lead, at, diagonal)
        equal[lo : lo + len(n)] |= n == _N
        passed[lo : lo + len(n)] |= n >= _N - _STRAY
        for s, e in found:
            if not done[s:e].all():
                spans.append((s, e))
                done[s:e] = True
        same = order[edge[own_group] : edge[own_group + 1]]
        if len(same) > 1:
            whole = lo <= max(0, diagonal), lo + len(n) + _N > min(len(own), len(lead) + diagonal)
            low, high = 0 if whole[0] else lo, len(own) if whole[1] else lo + len(n)
            seen[same[(starts[same] >= low) & (last[same] < high)]] = 0
    return spans, asked & ~equal, asked & ~passed


def segments(windows: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """The marked windows as stretches: where one begins, its length, and whether all of it is marked ``failed`` or none."""
    state = np.zeros(len(windows) + 2, np.int8)
    state[1:-1] = windows
    state[1:-1] += windows & failed
    edge = np.flatnonzero(state[1:] != state[:-1])
    begin, length, kind = edge[:-1], np.diff(edge), state[edge[:-1] + 1]
    return (begin << 32 | length << 1 | (kind == 2))[kind > 0]


def stretched(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``segments``, whether each is marked ``failed``, and how many each stretch has."""
    length = stretches >> 1 & 0x7FFFFFFF
    windows = np.repeat((stretches >> 32) - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return windows, np.repeat(stretches & 1 == 1, length), length


def _bands(docs: DataFrame, bands: range, hot_values: np.ndarray | None = None, want: bool = False) -> DataFrame:
    """``key, node, run``; where ``hot_values`` are given, of all but them, or (``want``) of them alone."""
    held = docs.sparkSession.sparkContext.broadcast(hot_values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                keys, texts, runs = band_values(block, bands)
                if held.value is not None:
                    some = hot.among(keys, held.value) == want
                    keys, texts, runs = keys[some], texts[some], runs[some]
                if len(keys):
                    yield pa.record_batch([pa.array(keys), pa.array(nodes[block.first + texts]), pa.array(runs)], ["key", "node", "run"])

    return scratch.map_arrow(docs, run, "key long, node long, run long")


_APART = "most <> lead.node and (node <> lead.node or run <> lead.run)"


def _cold(rows: DataFrame) -> DataFrame:
    """``node, run, lead, several``: the rows of values that several documents have, but for the first row of each
    value (``lead``: its node and run), and whether there is more than one."""
    w = Window.partitionBy("key")
    led = rows.select("node", "run", F.min(F.struct("node", "run")).over(w).alias("lead"), F.max("node").over(w).alias("most"), (F.count(F.lit(1)).over(w) > 2).alias("several"))
    return led.where(_APART).drop("most")


def _warm(rows: DataFrame) -> DataFrame:
    """As ``_cold`` for the rows of hot values, which don't come together: the values' first rows, a list as short
    as that of the hot values, are looked up."""
    rows = scratch.save(rows, "hot-rows")
    found = sorted(rows.groupBy("key").agg(F.min(F.struct("node", "run")).alias("lead"), F.max("node").alias("most")).collect(), key=lambda r: r.key)
    held = rows.sparkSession.sparkContext.broadcast([np.array(x, np.int64) for x in ([r.key for r in found], [r.lead.node for r in found], [r.lead.run for r in found], [r.most for r in found])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, runs, most = held.value
        for batch in batches:
            key, node, place = (c.to_numpy() for c in batch.columns)
            at = np.searchsorted(keys, key)
            led = np.flatnonzero((most[at] != nodes[at]) & ((node != nodes[at]) | (place != runs[at])))
            lead = pa.StructArray.from_arrays([pa.array(nodes[at[led]]), pa.array(runs[at[led]])], ["node", "run"])
            yield pa.record_batch([pa.array(node[led]), pa.array(place[led]), lead, pa.array(np.ones(len(led), bool))], ["node", "run", "lead", "several"])

    return scratch.map_arrow(rows.select("key", "node", "run"), run, "node long, run long, lead struct<node:long,run:long>, several boolean")


def _stars(parts: list[DataFrame], warm: DataFrame | None) -> DataFrame:
    """Per pair of documents the runs that collide, each with the first of its value; a document that
    holds the first one is paired with itself for its other ones. ``parts``: rows of values that differ from
    part to part, dealt one part after another, so that less is shuffled at once; ``warm``: rows of hot
    values."""
    led = [_cold(rows) for rows in parts] + ([_warm(warm)] if warm is not None else [])
    led = reduce(DataFrame.union, [scratch.save(x, "met-rows") for x in led] if len(led) > 1 else led)
    return _runs(led)


def _runs(led: DataFrame) -> DataFrame:
    """Per pair of documents its runs."""
    return led.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.array_sort(F.collect_set(F.struct("run", F.col("lead.run").alias("other"), "several"))).alias("runs"))


def _shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text, in order."""
    for block in blocks(column):
        whole = rolling(block.words)
        for a, b in zip(block.begin[:-1].tolist(), block.begin[1:].tolist(), strict=True):
            yield whole[a : max(a, b - SIZE + 1)]


def _check(pairs: DataFrame, texts: DataFrame, again: bool) -> DataFrame:
    """``a, start, end, b`` for verified spans; where what isn't linked may meet ``again``, also ``a, b, key, failed`` for its
    parts and ``a, b, windows`` for its ``segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a", "start", "end", "b", "key", "failed", "windows"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            return pa.record_batch([columns.get(n, pa.nulls(len(columns["a"]), x)).cast(x) for n, x in zip(names, types, strict=True)], names)

        last, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            fields = [batch.column(2).flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy()).tolist()
            held = [x or b"" for x in batch.column(4).to_pylist()]
            new = [x != y for x, y in zip(held, [last, *held[:-1]], strict=True)]
            leads = _shingles(pa.array([x for x, y in zip(held, new, strict=True) if y], pa.binary()))
            last, begin = held[-1] if held else last, 0
            spans, keys, stretches = [], [], []
            for k, (end, own) in enumerate(zip(ends, _shingles(batch.column(3)), strict=True)):
                lead = next(leads) if new[k] else lead
                found, unequal, failed = compare(own, lead, *(x[begin:end] for x in fields), a[k] != b[k])
                begin = end
                spans += [(k, s, e) for s, e in found]
                if again and unequal.any():
                    keys.append((k, *part_keys(own, unequal, failed, b[k])))
                    stretches.append((k, segments(unequal, failed)))
            if spans:
                k, s, e = np.array(spans, np.int64).T
                yield rows(a=pa.array(a[k]), start=pa.array(s), end=pa.array(e), b=pa.array(b[k]))
            if keys:
                k = [k for k, _ in stretches]
                n = np.repeat(k, [len(x) for _, x, _ in keys])
                yield rows(a=pa.array(a[n]), b=pa.array(b[n]), key=pa.array(np.concatenate([x for _, x, _ in keys])), failed=pa.array(np.concatenate([x for _, _, x in keys])))
                places = np.cumsum([0, *(len(x) for _, x in stretches)])
                yield rows(a=pa.array(a[k]), b=pa.array(b[k]), windows=pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate([x for _, x in stretches]))))

    ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "runs", "ta", "tb").sortWithinPartitions("b")
    return scratch.map_arrow(both, run, "a long, start int, end int, b long, key long, failed boolean, windows array<long>")


def _sent(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, node, run, other, failed`` for the windows that have a part that is ``wanted`` of their document with their leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own, met in zip(batch.column(0).to_pylist(), _shingles(batch.column(2)), batch.column(1), strict=True):
                leaders, stretches, keys = (met.values.field(k) for k in range(3))
                windows, failed, length = stretched(stretches.flatten().to_numpy())
                leader = np.repeat(np.repeat(leaders.to_numpy(), stretches.value_lengths().to_numpy()), length)
                here = windows <= len(own) - _N  # else of another row with this doc_id
                windows, failed, leader = windows[here], failed[here], leader[here]
                if not len(windows):
                    continue
                sides = np.isin(parts(own, windows, leader), keys.flatten().to_numpy())
                marks = np.zeros((3, len(own) - _N + 1), bool)
                for mark, some in zip(marks, (*sides, failed & sides.any(0)), strict=True):
                    mark[windows[some]] = True
                if marks.any():
                    key, place, other, known, bad = met_again(own, *marks)
                    yield pa.record_batch([pa.array(key), pa.array(np.full(len(key), node, np.int64)), pa.array(place), pa.array(other, mask=~known), pa.array(bad)], ["key", "node", "run", "other", "failed"])

    both = wanted.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "met", "text")
    return scratch.map_arrow(both, run, "key long, node long, run long, other long, failed boolean")


def _by_key(rows: DataFrame, where: str, *found: Column) -> DataFrame:
    """``rows`` of the keys at which ``where`` holds for what is ``found``, with that. Keys are counted up before they
    are joined, so that frequent ones needn't come together."""
    keys = scratch.save(rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), *found).where(f"least <> most and ({where})").drop("least", "most"), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS // 10 else keys, "key")


def _wanted(checked: DataFrame) -> DataFrame:
    """``a, met``: for each document the leaders ``b`` with which it has a part that another document has too and where some
    window failed, with its ``windows`` there and these parts."""
    rows = checked.where("key is not null").select("key", F.col("a").alias("node"), "b", "failed")
    some = _by_key(rows, "bad", F.max("failed").alias("bad")).groupBy(F.col("node").alias("a"), "b").agg(F.collect_set("key").alias("wanted"))
    met = checked.where("windows is not null").select("a", "b", "windows").join(some, ["a", "b"])
    return met.groupBy("a").agg(F.collect_list(F.struct("b", "windows", "wanted")).alias("met"))


def _around(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``key, node, run`` of the windows around these words (``node, run``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = batch.column(0).to_numpy(), batch.column(2)
            texts = (w for block in blocks(batch.column(1)) for w in block.texts())
            for node, text, own in zip(nodes.tolist(), texts, places, strict=True):
                keys, runs = around(rolling(text), own.values.to_numpy())
                yield pa.record_batch([pa.array(keys), pa.array(np.full(len(keys), node, np.int64)), pa.array(runs)], ["key", "node", "run"])

    places = scratch.save(words.groupBy("node").agg(F.collect_set("run").alias("places")), "words")
    places = F.broadcast(places) if places.count() <= BROADCAST_ROWS // 10 else places
    return scratch.map_arrow(docs.join(places, "node").select("node", "text", "places"), run, "key long, node long, run long")


def _again(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs as those of ``_stars`` for what meets again; all of them pass the check."""
    words = _by_key(rows.where("other is not null"), "one <> another and bad", F.min("other").alias("one"), F.max("other").alias("another"), F.max("failed").alias("bad"))
    inside = scratch.save(_around(docs, words.select("node", "run")), "words-around")
    least = F.min(F.struct("node", "run")).alias("lead")
    led = [_by_key(rows.where("other is null").select("key", "node", "run", "failed"), "bad", least, F.max("failed").alias("bad")), _by_key(inside, "true", least)]
    led = reduce(DataFrame.union, [x.select("node", "run", "lead") for x in led]).where("node <> lead.node").select("node", "lead", "run", F.lit(False).alias("several"))
    # the check looks NEAR places around: one run tells for its neighbours on its diagonal
    at = F.shiftright("run", 12)
    near = [at - F.shiftright("lead.run", 12), F.floor(at * 2 / NEAR)]
    led = led.groupBy("node", F.col("lead.node").alias("b"), near[0].alias("diagonal"), near[1].alias("part")).agg(F.min(F.struct("run", "lead")).alias("x"))
    return _runs(led.select("node", "x.run", "x.lead", F.lit(False).alias("several")))


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the documents in ``pairs``; their ids are broadcast if few enough."""
    ids = scratch.save(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "met")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return scratch.save(docs.join(ids, "node", "left_semi"), "texts")


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents without those whose whole text a smaller doc_id has too, and the spans of these."""
    hashed = docs.withColumn("hash", F.unhex(F.sha1("text")))
    known = scratch.save(hashed.select("node", "hash"), "hashes")
    first = scratch.save(known.groupBy("hash").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("hash", "b"), "first-copies")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS // 10 else first
    again = scratch.save(known.join(first, "hash").where("node > b").distinct(), "copies")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS // 10 else again
    n = F.size(F.filter(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    n = F.when(F.col("b") < F.col("node"), n)  # always so: else every text is split before the join
    spans = hashed.join(again, ["node", "hash"]).select(F.col("node").alias("a"), F.lit(0).alias("start"), n.alias("end"), "b").where(F.col("end") >= WORDS)
    # only texts with such a doc_id are hashed anew, each time that the rest is read
    gone = scratch.save(again.groupBy(F.col("node").alias("own")).agg(F.collect_set("hash").alias("hashes")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 10 else gone
    return docs.join(gone, (F.col("node") == F.col("own")) & F.array_contains("hashes", F.unhex(F.sha1("text"))), "left_anti"), spans


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_word, end_word, keeper_id, component_id``: the spans to remove."""
    docs = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").cast("binary").alias("text")).where("node is not null")
    some = hot.sampled("node", docs.count())
    docs, copies = _copies(docs)
    keys, spans = hot.hot_keys(_bands(docs.where(some), range(BANDS)), "key"), scratch.save(copies, "copy-spans")
    halves, warm = [_bands(docs, half, keys) for half in _HALVES], _bands(docs, range(BANDS), keys, True) if len(keys) else None
    pairs = scratch.save(_stars(halves, warm), "pairs")
    texts = _texts(docs, pairs)
    checked = scratch.save(_check(pairs, texts, True), "checked")
    wanted = scratch.save(_wanted(checked), "wanted")
    rows = scratch.save(_sent(wanted, texts), "met-again")
    scratch.discard(pairs, wanted, texts)
    pairs = scratch.save(_again(docs, rows), "pairs")
    texts = _texts(docs, pairs)
    last = scratch.save(_check(pairs, texts, False), "checked")
    scratch.discard(pairs, texts)
    for x in (checked, last):
        spans = spans.union(x.where("start is not null").select("a", "start", "end", "b"))
    spans = scratch.save(spans.distinct(), "spans")
    roots = connected_components(spans.select("a", "b").distinct())
    out = spans.groupBy("a", "start", "end").agg(F.min("b").alias("b")).join(roots.withColumnRenamed("node", "a"), "a", "left")
    return out.select(F.col("a").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("b").alias("keeper_id"), F.col("root").alias("component_id"))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words that the spans number, and one blank after each run of them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    gone = np.zeros(len(places) + 1, bool)
    for start, end in spans:
        gone[start:end] = True
    edge = np.diff(np.concatenate([[0], gone[:-1].astype(np.int8), [0]]))
    out, at = [], 0
    for s, e in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
        out.append(data[at : places[s][0]])
        at = min(len(data), places[e - 1][1] + 1)
    return b"".join([*out, data[at:]]).decode()


def cut(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of ``spans``. Texts of which no word is left go; texts without a
    span stay as they are. ``n_chars``, if there, follows the text."""
    node, places = scratch.free_name(docs, "node"), scratch.free_name(docs, "spans")
    spans = spans.select(F.col("doc_id").alias(node), F.array("start_word", "end_word").alias(places))
    marked = scratch.save(spans.groupBy(node).agg(F.flatten(F.collect_list(places)).alias(places)), "cuts")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS // 10 else marked

    @F.pandas_udf("string")
    def without(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, list(zip(p[::2].tolist(), p[1::2].tolist(), strict=True))) for t, p in zip(texts, places, strict=True)])

    own = F.col(doc_id) == F.col(node)
    changed = docs.join(marked, own).withColumn(text, without(F.col(text), F.col(places))).where(F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return docs.join(marked, own, "left_anti").unionByName(changed.select(*docs.columns))

"""Exact n-gram Jaccard join by a token-group matrix.

1. Documents with equal shingle sets are one class; its smallest doc_id stands for it.
2. Similar classes are partitioned into groups: classes that share a pair of min-hashes are compared
   with the smallest of them (a star, never all pairs), and verified links are joined up.
3. The token-group matrix holds, for each group, the union of its classes' prefix tokens. Shingles are
   ordered by rarity (an estimate from a fixed-size sketch that all documents feed), then by hash; of
   n shingles only the first n - ceil(0.8 n) + 1 can be the first ones that two similar sets share.
   Tokens of a single class are dropped at once.
4. A class of one group and another group meet if they share a prefix token; how many they share and
   where the shared ones stand bounds the overlap that is still possible, and drops most. The group
   is opened slice by slice (so that no task holds a large one): a slice whose token union holds too
   few of the class's shingles is left shut, and the rest is compared set by set.
5. Links of steps 2 and 4 together give the components.

Any pair of linked classes either is in one group already, so that its link can't change a component,
or shares a prefix token and meets in step 4: the components are exact. Sketch and min-hashes only
decide how much work there is. Step 4 works for the smaller group of the two.

Defined cases: a null or empty text has no shingles and is linked with nothing; rows of one doc_id are
one document, which links where any of its texts links; a null doc_id is linked with nothing and has
a null component; repeated rows come back row by row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hot, scratch
from .components import connected_components
from .shingles import Block, blocks, mix, overlap, shingle_set, shingle_sets, similar

PERCENT = 80
#: Star keys per class, each of so many min-hashes: a pair at 0.8 shares one with 1 - (1 - 0.64)**8 > 0.999.
KEYS, ROWS = 8, 2
#: Counters of the rarity sketch, and how many go into one of its rows.
SKETCH, SKETCH_ROW = 1 << 21, 1 << 16
#: Classes in a slice of a group, on average at most.
SLICE = 128
#: Classes that ask a slice of a group together, on average at most.
ASKING = 128
#: Id lists of at most so many rows are broadcast (8 bytes a row), longer ones are joined by key.
BROADCAST_ROWS = 1_000_000

#: Odd factors: each orders all 64-bit values anew, by a bijection.
_SEEDS = mix(np.arange(1, KEYS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _joined(block: Block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The shingle sets of a block's texts, the sets that aren't empty one after another, and where each of
    those begins."""
    sets = list(shingle_sets(block))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = sizes[sizes > 0]
    return sets, np.concatenate([block.words[:0], *sets]), np.cumsum(some) - some


def star_keys(joined: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """KEYS signed 64-bit keys, each from ROWS min-hashes, for each set that isn't empty."""
    out = np.zeros((len(begins), KEYS), np.uint64)
    if len(begins):
        with np.errstate(over="ignore"):
            for k in range(KEYS):
                h = np.full(len(begins), k, np.uint64)
                for r in range(ROWS):
                    low = np.minimum.reduceat(joined * _SEEDS[k * ROWS + r], begins)
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + low)
                out[:, k] = h
    return out.view(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _limited(ids: DataFrame, n: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sig, keys`` for every row of (doc_id, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, joined, begins = _joined(block)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                sig = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                bounds = pa.array(np.append(0, np.cumsum((n > 0) * KEYS)), pa.int32())
                keys = pa.ListArray.from_arrays(bounds, pa.array(star_keys(joined, begins).ravel()))
                yield pa.record_batch([batch.column(0).slice(block.first, len(block)), pa.array(n), pa.array(sig, pa.binary()), keys], ["doc_id", "n", "sig", "keys"])

    return scratch.map_arrow(docs, run, "doc_id long, n long, sig binary, keys array<long>")


def rarity_sketch(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each of SKETCH hash classes occur, over all (doc_id, text) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for block in blocks(batch.column(1)):
                total += np.bincount((_joined(block)[1] & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        rows = [press.compress(total[at : at + SKETCH_ROW].tobytes()) for at in range(0, SKETCH, SKETCH_ROW)]
        yield pa.record_batch([pa.array(range(len(rows)), pa.int32()), pa.array(rows)], ["block", "counts"])

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, unpress = np.zeros(SKETCH_ROW, np.uint64), zstandard.ZstdDecompressor()
        for part in parts:
            for row in part.counts:
                total += np.frombuffer(unpress.decompress(row), np.uint32)
        yield pd.DataFrame({"block": [key[0]], "counts": [zstandard.compress(total.tobytes(), 1)]})

    rows = scratch.map_arrow(docs, count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    out = np.zeros(SKETCH, np.float32)  # bounded: SKETCH counters
    for r in rows:
        out[r.block * SKETCH_ROW : (r.block + 1) * SKETCH_ROW] = np.frombuffer(zstandard.decompress(bytes(r.counts)), np.uint64)
    return out


def prefix_tokens(docs: DataFrame, sketch: np.ndarray, percent: int, hot_tokens: np.ndarray | None = None, want: bool = False) -> DataFrame:
    """``token, node, at, n``: the rarest shingles of each row, as many as a similar set can miss and
    one; ``at`` is a shingle's place in the order of all n. Where ``hot_tokens`` are given, of all tokens but
    them, or (``want``) of them alone."""
    chosen = docs.sparkSession.sparkContext.broadcast(hot_tokens)
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = held.value.view(np.uint32)  # floats of one sign are ordered as their bits are
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                sets, joined, begins = _joined(block)
                order = rarity[(joined & np.uint64(SKETCH - 1)).astype(np.int64)]
                some = np.array([k for k, x in enumerate(sets) if len(x)], np.int64)
                # a stable sort of sorted shingles: by rarity, then by hash
                found = [sets[k][np.argsort(order[at : at + len(sets[k])], kind="stable")[: prefix_length(len(sets[k]), percent)]] for k, at in zip(some.tolist(), begins.tolist(), strict=True)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                n = np.fromiter((len(sets[k]) for k in some), np.int32, len(some))
                if found:
                    columns = np.concatenate(found).view(np.int64), np.repeat(nodes[block.first + some], sizes), places.astype(np.int32), np.repeat(n, sizes)
                    if chosen.value is not None:
                        kept = hot.among(columns[0], chosen.value) == want
                        columns = tuple(c[kept] for c in columns)
                    yield pa.record_batch([pa.array(c) for c in columns], ["token", "node", "at", "n"])

    return scratch.map_arrow(docs, run, "token long, node long, at int, n int")


def verified(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``edges`` whose texts are similar; pairs of one b come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                b = b.as_py() or b""
                if b != last:
                    last, own = b, shingle_set(b)
                keep.append(similar(shingle_set(a.as_py() or b""), own, percent))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = edges.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").sortWithinPartitions("b")
    return scratch.map_arrow(both, run, "a long, b long").distinct()


def links(docs: DataFrame, described: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: links between doc_ids that give the components. ``docs``: (doc_id, text binary);
    ``described``: ``describe(docs)``, saved."""
    some = described.where("n > 0 and doc_id is not null")
    classes = scratch.save(some.groupBy("sig").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("keys").alias("keys")), "classes")
    same = some.select("doc_id", "sig").join(classes.select("sig", "node"), "sig").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    copies = scratch.save(same, "copies")
    n_copies = copies.count()

    # groups: stars around the smallest class of each key
    keyed = classes.select("node", F.posexplode("keys").alias("k", "key"))
    heads = keyed.groupBy("k", "key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "key", "b")
    stars = scratch.save(keyed.join(heads, ["k", "key"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "stars")
    met = scratch.save(stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), "met")
    texts = scratch.save(docs.join(_limited(met.withColumnRenamed("node", "doc_id"), met.count()), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
    star_links = scratch.save(verified(stars, texts, percent), "star-links")
    grouped = scratch.save(connected_components(star_links), "groups")

    # the matrix: prefix tokens of one document per class, kept where several classes have them
    distinct = docs.where("doc_id is not null").join(_limited(copies.select(F.col("a").alias("doc_id")).distinct(), n_copies), "doc_id", "left_anti")
    distinct, sketch = distinct.select("doc_id", "text"), rarity_sketch(distinct.select("doc_id", "text"))
    # tokens that are hot in a sample are shared for sure, so their rows needn't come together
    frequent = hot.hot_keys(prefix_tokens(distinct.where(hot.sampled("doc_id", classes.count())), sketch, percent), "token")
    cold, warm = prefix_tokens(distinct, sketch, percent, frequent), prefix_tokens(distinct, sketch, percent, frequent, True) if len(frequent) else None
    w = Window.partitionBy("token")
    shared = cold.select("*", F.min("node").over(w).alias("low"), F.max("node").over(w).alias("high")).where("low <> high").drop("low", "high")
    shared = shared if warm is None else shared.union(warm.select(*shared.columns))
    rows = scratch.save(shared.join(grouped, "node", "left").select("token", "node", "at", "n", F.coalesce("root", "node").alias("g")), "matrix-rows")
    sizes = grouped.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size")).withColumnRenamed("root", "g")
    cells = scratch.save(rows.groupBy("token", "g").agg(F.max(F.col("n") - F.col("at") - 1).alias("rest"), F.min("n").alias("least"), F.max("n").alias("most")), "matrix-cells")
    several = scratch.save(cells.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token"), "met-tokens")
    matrix = cells.join(several, "token", "left_semi").join(sizes, "g", "left")
    matrix = scratch.save(matrix.withColumn("size", F.coalesce("size", F.lit(1))), "matrix")
    other = matrix.select("token", F.col("g").alias("h"), "size", "rest", "least", "most")
    asking = rows.join(matrix.select("token", "g", F.col("size").alias("own")), ["token", "g"])
    met = asking.join(other, "token").where("g <> h and (own < size or own = size and g < h)")
    met = met.where(f"100 * most >= {percent} * n and 100 * n >= {percent} * least")
    met = met.groupBy("node", "h").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("at", "rest")).alias("last"), F.min("at").alias("first"), F.max("n").alias("n"), F.max("size").alias("size"), F.min("least").alias("least"))
    # the overlap that is still possible: with one class, the shared prefix tokens and what follows the
    # last of them on the shorter side; with several, all from the first shared token on
    possible = F.when(F.col("size") == 1, F.col("c") + F.least(F.col("n") - F.col("last.at") - 1, F.col("last.rest"))).otherwise(F.col("n") - F.col("first"))
    asks = met.where((100 + percent) * possible >= percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))))
    asks = scratch.save(asks.select("node", "h", "size"), "asks")

    opened = _open(docs, asks, grouped, percent)
    return copies.union(star_links).union(opened)


def _open(docs: DataFrame, asks: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for each asking class and group, a member of each slice that it is similar to, if any.

    One link to a slice is enough, as the members of a group are joined up already."""
    wanted = asks.select("h", "size").distinct()
    members = grouped.select(F.col("node").alias("m"), F.col("root").alias("h")).union(grouped.select(F.col("root").alias("m"), F.col("root").alias("h")).distinct())
    members = wanted.join(members, "h", "left").select("h", "size", F.coalesce("m", "h").alias("m"))
    slices = lambda size: F.ceil(size / SLICE).cast("int")
    members = scratch.save(members.select("m", "h", F.pmod(F.xxhash64("m"), slices(F.col("size"))).cast("int").alias("s")), "members")
    # queries come in blocks, each with a copy of the slice: no task holds all that ask one group
    ways = scratch.save(asks.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("ways")), "ways")
    asks = asks.join(ways, "h").withColumn("q", F.pmod(F.xxhash64("node"), F.col("ways")))
    queries = asks.select("node", "h", "q", F.explode(F.sequence(F.lit(0), slices(F.col("size")) - 1)).alias("s"))
    ids = scratch.save(members.select(F.col("m").alias("doc_id")).union(asks.select("node")).distinct(), "opened")
    texts = scratch.save(docs.join(_limited(ids, ids.count()), "doc_id", "left_semi"), "opened-texts")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [shingle_set(t or b"") for t in left.mt]
        union = np.unique(np.concatenate(sets))
        found = []
        for node, text in zip(right.node, right.qt, strict=True):
            q = shingle_set(text or b"")
            if 100 * overlap(q, union) < percent * len(q):
                continue  # the slice stays shut
            hit = next((m for m, s in zip(left.m, sets, strict=True) if similar(q, s, percent)), None)
            if hit is not None:
                found.append((node, hit))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    named = lambda node, text: texts.select(F.col("doc_id").alias(node), F.col("text").alias(text))
    left = members.join(named("m", "mt"), "m").join(ways, "h").select(F.col("h").alias("mh"), F.col("s").alias("ms"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways").cast("long") - 1)).alias("mq"), "m", "mt")
    right = queries.join(named("node", "qt"), "node").select(F.col("h").alias("qh"), F.col("s").alias("qs"), F.col("q").alias("qq"), "node", "qt")
    return left.groupBy("mh", "ms", "mq").cogroup(right.groupBy("qh", "qs", "qq")).applyInPandas(compare, "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    described = scratch.save(describe(picked), "described")
    roots = connected_components(links(picked, described, percent))
    out = described.select("doc_id", "n").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))

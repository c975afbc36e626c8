"""Content-addressed store for token ids.

``write_store`` leaves in a folder:

* ``packs/*.bin``: chunk bodies (ids, zstd-compressed), each unique chunk once;
* ``chunks`` (Parquet): chunk hash -> pack, offset, size, ids;
* ``recipes`` (Parquet, ascending doc_id): per document its chunk hashes in order and the Merkle root
  over them, with the number of ids before it inside its part;
* ``manifest`` (Parquet): per recipe part its documents, ids, base offset and Merkle root;
* ``root``: the Merkle root over the parts.

A rolling hash over ids sets chunk ends, so equal passages give equal chunks whatever stands before
them. Ids are encoded once: tasks write packs whose chunks are unique within the pack, only hashes
and places are shuffled to choose one copy of each, and packs that hold copies chosen elsewhere are
rewritten without them. ``read_store`` fetches chunks by byte range and checks every chunk hash and
document root, raising ``StoreError`` on a mismatch.

Defined cases: a null or empty text is the end id alone; repeated rows and doc_ids are stored row by
row (their order among themselves is that of their texts' hash); a null doc_id sorts first; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .encode import with_end, worker_encoder

#: A chunk ends where this many low bits of the rolling hash are zero ...
CUT_BITS = 9
#: ... but holds at least and at most so many ids (the last one of a document may be shorter).
MIN_IDS, MAX_IDS = 128, 4096
#: The rolling hash sees this many ids (a power of two).
ROLL = 16
#: A pack is closed once it holds so many bytes.
PACK_BYTES = 16 << 20
#: ... or its documents so many chunks, equal ones among them.
PACK_CHUNKS = 100_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class StoreError(ValueError):
    """What was read is not what was written."""


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """The places after which the rolling hash allows a cut. A hash may reach back into the document
    before; no cut is made that near to a document's start."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        factor, step = np.uint64(0xBF58476D1CE4E5B9), 1
        while step < ROLL:  # h[i] covers twice as many ids each time
            h[step:] = h[step:] + factor * h[:-step]
            factor, step = factor * factor, 2 * step
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64((1 << CUT_BITS) - 1)) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    """The ends of the chunks of a document of ``n`` ids with these marks."""
    ends, last = [], 0
    for m in marks:
        while m - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if m - last >= MIN_IDS and m < n:
            last = m
            ends.append(last)
    while n - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    return [*ends, n] if n > last else ends


def chunk_ends(ids: np.ndarray) -> list[int]:
    """The ends of the chunks that one document's ``ids`` are cut into."""
    return _ends(cut_marks(ids).tolist(), len(ids))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is. No leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


class Merkle:
    """``merkle_root`` of leaves that come one by one, in memory that grows with their number's logarithm."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, h = 0, hashlib.sha256(b"\x00" + leaf).digest()
        while self.nodes and self.nodes[-1][0] == level:
            h = hashlib.sha256(b"\x01" + self.nodes.pop()[1] + h).digest()
            level += 1
        self.nodes.append((level, h))

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        h = self.nodes[-1][1]
        for _, left in self.nodes[-2::-1]:
            h = hashlib.sha256(b"\x01" + left + h).digest()
        return h


_STAGED = "doc_id long, n_tokens long, root binary, pack string, row int, hashes array<binary>, offsets array<long>, sizes array<int>, counts array<int>"


def _stage(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode, cut and write task-wise packs; per document its recipe and where its chunks are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = worker_encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        head = struct.pack("<4sI", b"WFTK", encoder.width)
        flat = {"hashes": pa.binary(), "offsets": pa.int64(), "sizes": pa.int32(), "counts": pa.int32()}
        name, parts, at, known = "", [], 0, {}
        keys, sizes, roots, ends, chunks = [], [], [], [0], {k: [] for k in flat}

        def begin() -> None:
            nonlocal name, parts, at, known
            name, parts, at, known = f"{uuid.uuid4().hex}.bin", [head], len(head), {}
            for c in (keys, sizes, roots, ends, *chunks.values()):
                c.clear()
            ends.append(0)

        def close() -> pa.RecordBatch:
            scratch.put(f"{folder}/{name}", b"".join(parts))
            n, bounds = len(keys), pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(chunks[k], t)) for k, t in flat.items()]
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(roots, pa.binary()), pa.array([name] * n), pa.array(range(n), pa.int32()), *lists]
            return pa.record_batch(columns, ["doc_id", "n_tokens", "root", "pack", "row", *flat])

        begin()
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, found, lengths in encoder.blocks(batch.column(1)):
                ids, lengths = with_end(found, lengths, end_id)
                marks, to = cut_marks(ids), np.cumsum(lengths)
                cuts = np.searchsorted(marks, np.append(0, to), "right")
                starts, marks = (to - lengths).tolist(), marks.tolist()
                for k, (begins, n) in enumerate(zip(starts, lengths.tolist(), strict=True)):
                    hashes, last = [], begins
                    for end in _ends([m - begins for m in marks[cuts[k] : cuts[k + 1]]], n):
                        body = ids[last : begins + end].tobytes()
                        digest = hashlib.sha256(body).digest()
                        place = known.get(digest)
                        if place is None:
                            packed = press.compress(body)
                            place = known[digest] = at, len(packed)
                            parts.append(packed)
                            at += len(packed)
                        hashes.append(digest)
                        chunks["offsets"].append(place[0])
                        chunks["sizes"].append(place[1])
                        chunks["counts"].append(begins + end - last)
                        last = begins + end
                    chunks["hashes"] += hashes
                    ends.append(len(chunks["hashes"]))
                    keys.append(ids_of[first + k])
                    sizes.append(n)
                    roots.append(merkle_root(hashes))
                    if at >= PACK_BYTES or len(chunks["hashes"]) >= PACK_CHUNKS:
                        yield close()
                        begin()
        if keys:
            yield close()

    return scratch.map_arrow(docs, write, _STAGED)


def _parts(recipes: DataFrame) -> list[tuple]:
    """``part, n_docs, n_ids, base, root`` of each part, from its recipes: bounded by the number of shuffle
    partitions. A part's recipes pass one by one, in their order."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, ids, tree = None, 0, 0, Merkle()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([tree.root()])], ["part", "n_docs", "n_ids", "root"])

        for batch in batches:
            for part, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, docs, ids, tree = part, 0, 0, Merkle()
                docs, ids = docs + 1, ids + n
                tree.add(root)
        if now is not None:
            yield out()

    ordered = recipes.select("part", "before", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "before").drop("before")
    found = scratch.map_arrow(ordered, roots, "part int, n_docs long, n_ids long, root binary").orderBy("part").collect()
    rows, base = [], 0
    for r in found:
        rows.append((r.part, r.n_docs, r.n_ids, base, bytes(r.root)))
        base += r.n_ids
    return rows


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """Write the store into the new folder ``path`` (shared by all executors); its Merkle root."""
    spark = docs.sparkSession
    staging = f"{path}/staging"
    _stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), tokenizer, end_id, f"{staging}/packs").write.parquet(f"{staging}/recipes")
    staged = spark.read.schema(_STAGED).parquet(f"{staging}/recipes")

    places = staged.select("pack", F.explode(F.arrays_zip("hashes", "offsets", "sizes", "counts")).alias("c"))
    owners = places.groupBy(F.col("c.hashes").alias("hash")).agg(F.min(F.struct("pack", F.col("c.offsets").alias("offset"), F.col("c.sizes").alias("size"), F.col("c.counts").alias("n_ids"))).alias("o"))

    def repack(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        """Copy the chunks that this pack keeps; a pack has at most PACK_BYTES and one batch of them."""
        chunks = chunks.sort_values("offset")
        fs, old = scratch.filesystem(f"{staging}/packs/{key[0]}")
        with fs.open_input_file(old) as f:
            data = f.read()
        parts, at, new = [data[:8]], 8, []
        for offset, size in zip(chunks.offset, chunks["size"], strict=True):
            parts.append(data[offset : offset + size])
            new.append(at)
            at += size
        name = f"{uuid.uuid4().hex}.bin"
        scratch.put(f"{path}/packs/{name}", *parts)
        return chunks.assign(offset=new, home=key[0], pack=name)[["hash", "home", "pack", "offset", "size", "n_ids"]]

    owners.select("hash", "o.*").groupBy("pack").applyInPandas(repack, "hash binary, home string, pack string, offset long, size int, n_ids int").write.parquet(f"{path}/chunks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
            local = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local.astype(np.int64))], [*batch.schema.names, "part", "before"])

    recipes = staged.select("doc_id", "n_tokens", "root", "hashes", F.col("pack").alias("home"), "row")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the place in the staged packs tells rows of one doc_id apart, so that a repeated or null one is dealt out too
    order = F.col("doc_id").asc_nulls_first(), "root", "home", "row"
    ordered = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    scratch.map_arrow(ordered, number, "doc_id long, n_tokens long, root binary, hashes array<binary>, home string, row int, part int, before long").write.parquet(f"{path}/recipes")

    rows = _parts(spark.read.parquet(f"{path}/recipes"))
    spark.createDataFrame(rows, "part int, n_docs long, n_ids long, base long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    root = merkle_root([r[-1] for r in rows])
    scratch.put(f"{path}/root", root.hex().encode())
    scratch.remove(staging)
    return root


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian uint32) of every stored document, verified:
    the parts against the manifest and its root at once, documents and chunks as they are read."""
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    manifest = spark.read.parquet(f"{path}/manifest")  # one row a part
    held = sorted((r.part, r.n_docs, r.n_ids, r.base, bytes(r.root)) for r in manifest.collect())
    fs, file = scratch.filesystem(f"{path}/root")
    with fs.open_input_file(file) as f:
        root = f.read().decode()
    if merkle_root([r[-1] for r in held]).hex() != root:
        raise StoreError("the manifest has another root than was written")
    if _parts(recipes) != held:
        raise StoreError("the recipes are not those of the manifest")
    wanted = recipes.select("part", "before", "home", F.posexplode("hashes").alias("at", "hash"))
    found = wanted.join(chunks.select("hash", "pack", "offset", "size"), "hash", "left")
    lists = found.groupBy("part", "before", "home").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "pack", "offset", "size"))).alias("c"))
    whole = recipes.select("doc_id", "n_tokens", "root", "part", "before").join(lists, ["part", "before"]).join(F.broadcast(manifest.select("part", "base")), "part")
    # documents written together stand together, so that a task reads few packs
    near = whole.repartition(F.col("home")).sortWithinPartitions("home", "part", "before").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "root", "c.hash", "c.pack", "c.offset", "c.size")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = scratch.filesystem(f"{path}/packs")
        files: dict = {}
        unpress = zstandard.ZstdDecompressor()

        def chunk(pack: str, offset: int, size: int, digest: bytes) -> tuple[int, bytes]:
            if pack not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files)))[0].close()
                f = fs.open_input_file(f"{folder}/{pack}")
                magic, width = struct.unpack("<4sI", f.read_at(8, 0))
                if magic != b"WFTK":
                    raise StoreError(f"{pack} is no pack")
                files[pack] = f, width
            f, width = files[pack]
            body = unpress.decompress(f.read_at(size, offset), max_output_size=4 * MAX_IDS)
            if hashlib.sha256(body).digest() != digest:
                raise StoreError(f"a chunk of {pack} at {offset} has changed")
            return width, body

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if None in r["pack"]:
                    raise StoreError(f"document {r['doc_id']} lacks chunks")
                if merkle_root(r["hash"]) != r["root"]:
                    raise StoreError(f"document {r['doc_id']} has another recipe than was written")
                bodies = [chunk(*x) for x in zip(r["pack"], r["offset"], r["size"], r["hash"], strict=True)]
                ids = np.concatenate([np.frombuffer(b, f"<u{w}").astype("<u4") for w, b in bodies])
                if len(ids) != r["n_tokens"]:
                    raise StoreError(f"document {r['doc_id']} has {len(ids)} ids, not {r['n_tokens']}")
                rows.append((r["doc_id"], r["start"], len(ids), ids.tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])

    return scratch.map_arrow(near, fetch, "doc_id long, start long, n_tokens long, ids binary")

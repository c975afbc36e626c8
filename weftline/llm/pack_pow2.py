"""Packing by power-of-two decomposition.

A document's ids (an end id appended) are cut into pieces whose lengths are powers of two, none
longer than ``max_length``: whole ``max_length`` pieces first, then the binary digits of the rest,
largest first. Every piece is one training sequence, so a sequence never crosses documents and
needs no padding; sequences of one length form a bucket. The work is one map over the scan: no
shuffle, and nothing is gathered.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows and
repeated doc_ids are packed row by row; a null doc_id is kept; an empty table gives no pieces; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .encode import with_end, worker_encoder

MAX_LENGTH = 4096
#: Sequence ids hold the partition above this bit and a running number below it.
SEQUENCE_BITS = 40

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """The lengths that ``n`` ids are cut into.

    >>> piece_lengths(11, 4)
    [4, 4, 2, 1]
    """
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << k for k in range(max_length.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_length: int = MAX_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian uint32), ``doc_tokens,
    bucket`` (log2 of the length), ``sequence_id, offset``."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        columns: list[list] = [[] for _ in range(8)]
        held = 0

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in PIECES.split(", ")]
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, found, lengths in encoder.blocks(batch.column(1)):
                ids, lengths = with_end(found, lengths, end_id)
                data, at = ids.astype("<u4").tobytes(), 0
                for key, n in zip(keys[first:], lengths.tolist(), strict=False):
                    start = 0
                    for length in piece_lengths(n, max_length):
                        for c, v in zip(columns, (key, start, length, data[at : at + 4 * length], n, length.bit_length() - 1, sequence, 0), strict=True):
                            c.append(v)
                        start += length
                        at += 4 * length
                        sequence += 1
                    held += 4 * n
                    if held > 16 << 20:
                        held = 0
                        yield flush()
        if columns[0]:
            yield flush()

    return scratch.map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), cut, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences, one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)

"""Python data sources: tar shards of captioned images, and raw float16 vector files.

``spark.dataSource.register(TarShards)``, then ``spark.read.format("tar_shards").load(path)``, where
``path`` is a tar or a comma-separated list; one partition a tar. ``option("metadata", "true")`` reads all
JSON members in one pass and leaves image bytes unread. ``VectorFile`` reads ``(n, dim)`` little-endian
float16 rows by ranges, ``NpyVectors`` a numpy file.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str):
    import pyarrow.fs as pafs

    fs, inner = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class TarPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarShards(DataSource):
    """Ids that have both a picture and readable JSON, in the order of the archive."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return "tar_path string, within_shard_index int, key string, caption string, url string, image binary"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.metadata = str(options.get("metadata", "false")).lower() == "true"

    def partitions(self) -> list[TarPart]:
        return [TarPart(p) for p in self.paths]

    def read(self, partition: TarPart) -> Iterator[tuple]:
        if self.metadata:
            yield from self._metadata(partition.path)
            return
        try:
            archive = tarfile.open(fileobj=_open(partition.path))
            members = archive.getmembers()
        except (tarfile.TarError, OSError):
            return  # an unreadable shard holds no rows
        named = {m.name: m for m in members if m.isfile()}
        at = 0
        for name in named:
            stem, dot, kind = name.rpartition(".")
            if not dot or kind != "jpg" or f"{stem}.json" not in named:
                continue
            try:
                meta = json.loads(archive.extractfile(named[f"{stem}.json"]).read())
                caption, url = meta.get("caption"), meta.get("url")
            except (ValueError, AttributeError, tarfile.TarError):
                at += 1
                continue
            yield partition.path, at, stem, caption, url, archive.extractfile(named[name]).read()
            at += 1

    def _metadata(self, path: str) -> Iterator[tuple]:
        """Every readable JSON member in one pass, with or without its picture; what can't be read is
        passed over, and a broken archive ends where it breaks."""
        at = 0
        try:
            with tarfile.open(fileobj=_open(path), mode="r|*") as archive:
                for member in archive:
                    stem, dot, kind = member.name.rpartition(".")
                    if not (member.isfile() and dot and kind == "json"):
                        continue
                    try:
                        meta = json.loads(archive.extractfile(member).read())
                        row = path, at, stem, meta.get("caption"), meta.get("url"), None
                    except (ValueError, AttributeError):
                        at += 1
                        continue
                    yield row
                    at += 1
        except (tarfile.TarError, OSError, EOFError):
            return


class RowRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class VectorFile(DataSource):
    """``global_index, embedding`` from raw float16 rows; options path, dim, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "float16_vectors"

    def schema(self) -> str:
        return "global_index long, embedding array<float>"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dim = options["path"], int(options["dim"])
        self.rows = int(options.get("rows_per_partition", 65_536))

    def partitions(self) -> list[RowRange]:
        with _open(self.path) as f:
            n, rest = divmod(f.size(), 2 * self.dim)
        if rest:
            raise ValueError(f"{self.path} holds no whole rows of {self.dim}")
        return [RowRange(k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator:
        with _open(self.path) as f:
            data = f.read_at((partition.end - partition.start) * 2 * self.dim, partition.start * 2 * self.dim)
        yield _batch(partition.start, data, "<f2", self.dim)


def _batch(start: int, data: bytes, kind: str, dim: int):
    """Rows of one width as an Arrow batch."""
    import numpy as np
    import pyarrow as pa

    rows = np.frombuffer(data, kind).astype(np.float32)
    n = len(rows) // dim
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rows))
    return pa.record_batch([pa.array(np.arange(start, start + n)), lists], ["global_index", "embedding"])


class NpyVectors(DataSource):
    """``global_index, embedding`` from a two-dimensional numpy file; options path, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "npy_vectors"

    def schema(self) -> str:
        return "global_index long, embedding array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows_per_partition", 65_536))

    def _header(self) -> tuple[tuple, str, int]:
        """Shape, kind of number, and where the numbers begin; read by the driver and by every task."""
        import numpy as np

        with _open(self.path) as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if len(shape) != 2 or by_column or kind.kind != "f":
                raise ValueError(f"{self.path} isn't a table of floats by row")
            return shape, kind.str, f.tell()

    def partitions(self) -> list[RowRange]:
        n = self._header()[0][0]
        return [RowRange(k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator:
        import numpy as np

        (_, dim), kind, offset = self._header()
        width = dim * np.dtype(kind).itemsize
        with _open(self.path) as f:
            data = f.read_at((partition.end - partition.start) * width, offset + partition.start * width)
        yield _batch(partition.start, data, kind, dim)

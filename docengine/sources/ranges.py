"""Data sources that read files by ranges: pieces, heads that grow until they are whole, digests in constant memory, a mail folder.

``register(spark)`` makes them formats by name.  Executors open the files themselves, through Arrow's file systems, so paths are those
that every executor can reach.  No file is ever held whole.

- ``file_ranges``: (path, size, start, content): the bytes of files as pieces; a partition is a range of ``range_bytes`` of one file.
- ``file_heads``: (path, size, content, whole): the first bytes of each file.  Model headers (GGUF, safetensors) say how long they are or
  show that they are cut; the head grows by doubling until it is whole, up to ``most_bytes``.
- ``file_digests``: (path, size, sha256, error): each file is streamed once.
- ``mail_folder``: a stream of (uid, path, size, content) over a folder with ``<uid>.eml`` files.  The offset is the last uid that was
  read, kept in the stream's checkpoint: a restart neither loses nor repeats a mail.  ``since_uid`` starts after a uid.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from docengine.operators.catalog import gguf_values

PIECE = 4 << 20
FIRST_HEAD, MOST_HEAD = 64 << 10, 256 << 20
#: Files that a partition takes where each is read a little.
TOGETHER = 256


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def _files(path: str, pattern: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder whose names match a pattern, in order of path."""
    fs, at = _place(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=recursive, allow_not_found=True)) if info.type == pafs.FileType.Directory else []
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and re.search(pattern, f.base_name))


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def head_size(head: bytes, size: int) -> int:
    """How many bytes a model's header needs, as far as its first bytes tell; at most what they are if they are enough."""
    if head[:4] == b"GGUF":
        return len(head) if len(head) >= size or gguf_values(head) is not None else 2 * len(head)
    if len(head) >= 8 and head[8:9] == b"{":
        (n,) = struct.unpack("<Q", head[:8])
        return min(size, 8 + n)
    return len(head)


class _Some(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.path, self.pattern = options["path"], options.get("name", "")

    def _listed(self) -> list[tuple[str, int]]:
        return _files(self.path, self.pattern, _flag(self.options, "recursive"))

    def partitions(self) -> list[_Some]:
        files = self._listed()
        return [_Some(files[i : i + TOGETHER]) for i in range(0, len(files), TOGETHER)] or [_Some([])]


class _Ranges(_Reader):
    def partitions(self) -> list[_Some]:
        step = int(self.options.get("range_bytes", 64 << 20))
        return [_Some([(p, size, s)]) for p, size in self._listed() for s in range(0, max(size, 1), step)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        step, piece = int(self.options.get("range_bytes", 64 << 20)), int(self.options.get("piece_bytes", PIECE))
        for path, size, start in partition.files:
            fs, at = _place(path)
            with fs.open_input_file(at) as f:
                f.seek(start)
                end = min(size, start + step)
                for s in range(start, end, piece):
                    yield path, size, s, f.read(min(piece, end - s))


class _Heads(_Reader):
    def read(self, partition: _Some) -> Iterator[tuple]:
        first, most = int(self.options.get("head_bytes", FIRST_HEAD)), int(self.options.get("most_bytes", MOST_HEAD))
        for path, size in partition.files:
            fs, at = _place(path)
            with fs.open_input_file(at) as f:
                head = f.read(min(size, first))
                while (need := min(head_size(head, size), size, most)) > len(head):
                    head += f.read(need - len(head))
                yield path, size, head, head_size(head, size) <= len(head)


class _Digests(_Reader):
    def partitions(self) -> list[_Some]:
        return [_Some([f]) for f in self._listed()] or [_Some([])]  # a digest runs through a file in order, so a file is a partition

    def read(self, partition: _Some) -> Iterator[tuple]:
        for path, size in partition.files:
            fs, at = _place(path)
            digest = hashlib.sha256()
            try:
                with fs.open_input_stream(at) as f:
                    while part := f.read(PIECE):
                        digest.update(part)
                yield path, size, digest.hexdigest(), None
            except OSError as e:
                yield path, size, None, f"{type(e).__name__}: {e}"


class _Mails(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.since = options["path"], int(options.get("since_uid", 0))

    def _uids(self, after: int) -> list[tuple[int, str, int]]:
        found = ((int(m[1]), p, size) for p, size in _files(self.path, r"^\d+\.eml$") if (m := re.search(r"(\d+)\.eml$", p)))
        return sorted(f for f in found if f[0] > after)

    def initialOffset(self) -> dict:  # noqa: N802 - names of the interface
        return {"uid": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        new = self._uids(self.since)
        return {"uid": new[-1][0] if new else self.since}

    def partitions(self, start: dict, end: dict) -> list[_Some]:
        files = [f for f in self._uids(start["uid"]) if f[0] <= end["uid"]]
        return [_Some(files[i : i + TOGETHER]) for i in range(0, len(files), TOGETHER)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        for uid, path, size in partition.files:
            fs, at = _place(path)
            with fs.open_input_stream(at) as f:
                yield uid, path, size, f.read()

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint keeps the offset and the folder its mails."""


def _source(format_: str, columns: str, reader: type | None = None, stream: type | None = None) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_

        def schema(self) -> str:
            return columns

        def reader(self, schema):
            return reader(dict(self.options))

        def streamReader(self, schema):  # noqa: N802
            return stream(dict(self.options))

    return Source


SOURCES = {
    "file_ranges": _source("file_ranges", "path string, size long, start long, content binary", _Ranges),
    "file_heads": _source("file_heads", "path string, size long, content binary, whole boolean", _Heads),
    "file_digests": _source("file_digests", "path string, size long, sha256 string, error string", _Digests),
    "mail_folder": _source("mail_folder", "uid long, path string, size long, content binary", None, _Mails),
}


def register(spark: SparkSession, *names: str) -> None:
    """Make the sources (by default all) known to the session by their names."""
    for name in names or SOURCES:
        spark.dataSource.register(SOURCES[name])


def connect(spark: SparkSession, connector: str, stream: bool = False, **options: object) -> DataFrame:
    """A registered source by its name; an unknown name is an error that lists the known ones."""
    if connector not in SOURCES:
        raise ValueError(f"no connector {connector!r}; there are {', '.join(sorted(SOURCES))}")
    register(spark, connector)
    reader = (spark.readStream if stream else spark.read).format(connector)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()

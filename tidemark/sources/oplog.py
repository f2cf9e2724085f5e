"""Framed operation log files, and a Spark data source over them.

A record is crc32 (4 bytes, of all that follows it), length of the body (4), kind (1: put, 2: delete), length of the
key (4), key, value. Numbers are big-endian. A crash can tear the end of a file, so a file counts up to its first
record that is cut short or fails its checksum.
"""

from __future__ import annotations

import os
import struct
import threading
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.files import filesystem, force, names

FORMAT = "tidemark_oplog"
SUFFIX = ".log"
#: A file of the sink is ended once it is so large.
SEGMENT_BYTES = 128 << 20
_HEAD = struct.Struct(">II")
_BODY = struct.Struct(">BI")
PUT, DELETE = 1, 2


def frame(key: bytes, value: bytes | None) -> bytes:
    body = _BODY.pack(DELETE if value is None else PUT, len(key)) + key + (value or b"")
    rest = struct.pack(">I", len(body)) + body
    return struct.pack(">I", zlib.crc32(rest)) + rest


def records(f) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(offset, key, value or None for a delete) of the valid records that a binary file begins with."""
    at = 0
    while len(head := f.read(_HEAD.size)) == _HEAD.size:
        check, size = _HEAD.unpack(head)
        if size < _BODY.size:
            return
        body = f.read(size)
        if len(body) < size or zlib.crc32(head[4:] + body) != check:
            return
        kind, n = _BODY.unpack_from(body)
        key, value = body[_BODY.size : _BODY.size + n], body[_BODY.size + n :]
        if len(key) < n or kind not in (PUT, DELETE) or (kind == DELETE and value):
            return
        yield at, key, None if kind == DELETE else value
        at += _HEAD.size + size


class LogWriter:
    """Appends under a lock of the caller; sync may be called by many threads, of which one forces the file for all."""

    def __init__(self, path: str, group_commit: bool = True):
        self.path, self.group = path, group_commit
        self.fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
        self.written = self.synced = self.syncs = 0
        self.turn = threading.Condition()
        self.leading = False
        self.failed: OSError | None = None
        directory = os.open(os.path.dirname(path), os.O_RDONLY)
        try:
            os.fsync(directory)
        finally:
            os.close(directory)

    def append(self, key: bytes, value: bytes | None) -> int:
        """The offset behind the record, for sync."""
        data = memoryview(frame(key, value))
        while data:
            data = data[os.write(self.fd, data) :]
        self.written = os.lseek(self.fd, 0, os.SEEK_CUR)
        return self.written

    def sync(self, offset: int) -> None:
        """Return once everything before offset is on disk. After a failure no later call succeeds: what a retry says can't be trusted."""
        with self.turn:
            while True:
                if self.failed:
                    raise OSError("an earlier sync failed") from self.failed
                if self.synced >= offset:
                    return
                if not self.leading:
                    self.leading = True
                    break
                self.turn.wait()
        upto, error = self.written, None
        try:
            os.fsync(self.fd)
        except OSError as e:
            error = e
        with self.turn:
            self.leading = False
            if error:
                self.failed = error
            else:
                self.synced = max(self.synced, upto)
                self.syncs += 1
            self.turn.notify_all()
        if error:
            raise error

    def close(self) -> None:
        if self.fd >= 0:
            try:
                self.sync(self.written)
            finally:
                os.close(self.fd)
                self.fd = -1


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    """One task per file: a record can only be found from the one before it. Writers keep files to SEGMENT_BYTES, about."""

    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_File]:
        return [_File(p) for p in names(self.uri, SUFFIX)]

    def read(self, partition: _File):
        import pyarrow as pa

        name, held, size = os.path.basename(partition.path), [], 0

        def batch():
            at, keys, values = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(at, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array([v is None for v in values])], names=["segment", "position", "key", "value", "is_delete"])

        files, _ = filesystem(self.uri)
        with files.open_input_stream(partition.path) as f:
            for record in records(f):
                held.append(record)
                size += len(record[1]) + len(record[2] or b"")
                if len(held) == 8192 or size >= 4 << 20:
                    yield batch()
                    held.clear()
                    size = 0
        if held:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, temporary: list[str]):
        self.temporary = temporary


class _Writer(DataSourceArrowWriter):
    """Each task writes files of its own, and the whole job's take their names when it commits: the job's number, which is
    one above those there, the task's and the file's. So segments order as jobs were committed, and as tasks within one."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite

    def write(self, batches) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, path = filesystem(self.uri)
        files.create_dir(path, recursive=True)
        made, f, size = [], None, 0
        for batch in batches:
            keys, values, gone = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "value", "is_delete"))
            for start in range(0, len(keys), 1024):
                part = slice(start, start + 1024)
                if any(k is None or g is None or (v is None and not g) for k, v, g in zip(keys[part], values[part], gone[part], strict=True)):
                    raise ValueError("null key or is_delete, or null value of a put")
                data = b"".join([frame(k, None if g else v) for k, v, g in zip(keys[part], values[part], gone[part], strict=True)])
                if f is None:
                    made.append(f"{path}/.{context.partitionId():06d}-{len(made):06d}.{context.taskAttemptId()}.tmp")
                    f, size = files.open_output_stream(made[-1]), 0
                f.write(data)
                size += len(data)
                if size >= SEGMENT_BYTES:
                    f.close()
                    f = None
        if f is not None:
            f.close()
        for m in made:
            force(files, m)
        return _Written(made)

    def commit(self, messages) -> None:
        files, path = filesystem(self.uri)
        there = names(self.uri, SUFFIX)
        job = 1 + max((int(n) for p in there if (n := os.path.basename(p).split("-")[0].removesuffix(SUFFIX)).isdigit()), default=0)
        for m in messages:
            for t in m.temporary if m else ():
                files.move(t, f"{path}/{job:06d}-{os.path.basename(t).split('.')[1]}{SUFFIX}")
        if self.overwrite:
            for p in there:
                files.delete_file(p)
        if there or any(m and m.temporary for m in messages):
            force(files, path)

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, _ = filesystem(self.uri)
        for m in messages:
            for t in m.temporary if m else ():
                if files.get_file_info(t).type != fs.FileType.NotFound:
                    files.delete_file(t)


class OpLogSource(DataSource):
    """spark.read.format(FORMAT).load(path): segment, position, key, value, is_delete; path is a file or folder, of any file system that pyarrow opens by URI."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "segment string, position bigint, key binary, value binary, is_delete boolean"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(OpLogSource)

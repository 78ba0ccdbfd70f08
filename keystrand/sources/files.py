"""Lines, whole files, key-value frames, length-prefixed sequences, and commands as sources and sinks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keystrand.functions.text import split_pair
from keystrand.functions.varint import encoded
from keystrand.plans.model import KEY_VALUE, SERIALIZED


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): one record a line, ended by a line feed alone; bytes that aren't UTF-8 outlast a cast to binary."""
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(line): each file as one record."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "line")


def pairs_of_lines(lines: DataFrame) -> DataFrame:
    """(key, value) of tab-separated lines; empty lines are skipped."""
    key, value = split_pair(F.col("line"))
    return lines.filter("line <> ''").select(key.alias("key"), value.alias("value"))


def count_bytes(rows: DataFrame, column: str) -> DataFrame:
    """(n_records, n_bytes): what a sink that only counts would have taken."""
    return rows.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long").alias("n_bytes"))


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def through_command(lines: DataFrame, command: str, allowed: bool = False) -> DataFrame:
    """(line): each partition's lines through a command's standard input and output. Off unless ``allowed``; a command
    that fails is an error."""
    if not allowed:
        raise PermissionError("through_command runs a command on the executors; pass allowed=True")
    out = lines.select("line").rdd.map(lambda r: r.line).pipe(command, checkCode=True)
    return lines.sparkSession.createDataFrame(out.map(lambda x: (x,)), "line string")


#: Bytes from which a written file is closed, and of the buffer before it.
FILE_BYTES, BUFFER_BYTES = 1 << 27, 1 << 20


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(name))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_stream(name)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.order = ">" if options.get("endian", "little") == "big" else "<"

    def partitions(self):
        return [FilePart(p) for p in _files(self.path)]


class KvReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        with _opened(partition.path) as f:
            while head := f.read(8):
                if len(head) < 8:
                    raise EOFError(f"{partition.path}: a record's lengths are cut short")
                klen, vlen = struct.unpack(f"{self.order}ii", head)
                if klen < 0 or vlen < 0:
                    raise ValueError(f"{partition.path}: a record has a length below 0")
                body = f.read(klen + vlen)
                if len(body) < klen + vlen:
                    raise EOFError(f"{partition.path}: a record is cut short")
                yield body[:klen], body[klen:]


class SeqReader(_Reader):
    def read(self, partition) -> Iterator[tuple]:
        with _opened(partition.path) as f:
            while b := f.read(1):
                n, shift = b[0] & 0x7F, 7
                while b[0] >= 0x80:
                    b = f.read(1)
                    if not b or shift > 63:
                        raise EOFError(f"{partition.path}: an item's length is cut short or too long")
                    n |= (b[0] & 0x7F) << shift
                    shift += 7
                body = f.read(n)
                if len(body) < n:
                    raise EOFError(f"{partition.path}: an item is cut short")
                yield (body,)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    """Files of a task, written under hidden names and renamed when the job commits. Names hold a number of the job's
    own, so appending leaves older files alone; overwriting deletes them once the new ones are whole. As only a walk from
    its start tells where a file's records begin, one file is one task for a reader; so a file that reaches
    ``maxFileBytes`` (128 MB if not given) is closed and another one begun."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.most = int(options.get("maxFileBytes", FILE_BYTES))
        if self.most < 1:
            raise ValueError("maxFileBytes is 1 at least")
        self.order = ">" if options.get("endian", "little") == "big" else "<"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def packed(self, row) -> bytes:
        raise NotImplementedError

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        task, names, rows = TaskContext.get(), [], iter(rows)
        row = next(rows, None)
        while row is not None or not names:
            names.append(f"{folder}/_part-{self.job}-{task.partitionId():06d}-{len(names):06d}-{task.taskAttemptId()}")
            size = 0
            with system.open_output_stream(names[-1], buffer_size=BUFFER_BYTES) as f:
                while row is not None and size < self.most:
                    record = self.packed(row)
                    f.write(record)
                    size += len(record)
                    row = next(rows, None)
        return Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        for path in self._written(messages):
            system.move(path, f"{folder}/{path.rsplit('/', 1)[1][1:].rsplit('-', 1)[0]}")
        for path in old if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, _ = self._system()
        for path in self._written(messages):
            system.delete_file(path)

    def _written(self, messages) -> list[str]:
        return [path for m in messages if m is not None for path in m.paths]


class KvWriter(_Writer):
    def packed(self, row) -> bytes:
        key, value = bytes(row[0]), bytes(row[1])
        return struct.pack(f"{self.order}ii", len(key), len(value)) + key + value


class SeqWriter(_Writer):
    def packed(self, row) -> bytes:
        body = bytes(row[0])
        length, _ = encoded(np.array([len(body)], np.uint64))
        return length.tobytes() + body


class KvBin(DataSource):
    """Records of two 32-bit lengths, a key and a value; option ``endian`` is little or big."""

    @classmethod
    def name(cls):
        return "kvbin"

    def schema(self):
        return KEY_VALUE

    def reader(self, schema):
        return KvReader(self.options)

    def writer(self, schema, overwrite):
        return KvWriter(self.options, overwrite)


class StrSeq(DataSource):
    """Byte strings after their lengths (variable-length, our reading), up to the end of the file."""

    @classmethod
    def name(cls):
        return "strseq"

    def schema(self):
        return SERIALIZED

    def reader(self, schema):
        return SeqReader(self.options)

    def writer(self, schema, overwrite):
        return SeqWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``kvbin`` and ``strseq`` known to ``spark.read.format``."""
    for source in (KvBin, StrSeq):
        spark.dataSource.register(source)

"""MatrixMarket coordinate files as a Spark data source: read by byte ranges, written by tasks and made whole by the driver.

A path is a file, or a folder that a write has left: one file with the header and one for each task, whose names are listed
in the header's file once all of them are there. Coordinates count from 1 in files and from 0 in tables. Symmetric and skew-symmetric
files come back with both triangles; pattern files with ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridweave.frame import SparseFrame

#: Bytes of a file that one task reads.
SPLIT_BYTES = 64 << 20
HEADER = "header.mtx"
FIELDS, SYMMETRIES = ("real", "integer", "pattern"), ("general", "symmetric", "skew-symmetric")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What the head of a file says, and where its entries begin."""

    field: str
    symmetry: str
    shape: tuple[int, int]
    entries: int
    begin: int


def read_header(path: str) -> Header:
    """The header of a file, or of the folder that a write has left; ValueError if it is none of a coordinate file."""
    store, name = _opened(path)
    if store.get_file_info(name).type == fs.FileType.Directory:
        name = f"{name.rstrip('/')}/{HEADER}"
    with store.open_input_stream(name) as stream:
        data, begin, kind = b"", 0, None
        while True:
            end = data.find(b"\n", begin)
            if end < 0:
                more = stream.read(65_536)
                if not more:
                    end = len(data)
                else:
                    data += more
                    continue
            line = data[begin:end].decode("latin-1").strip()
            begin = end + 1
            if kind is None:
                kind = line.lower().split()
                if len(kind) != 5 or kind[:3] != ["%%matrixmarket", "matrix", "coordinate"] or kind[3] not in FIELDS or kind[4] not in SYMMETRIES:
                    raise ValueError(f"not a coordinate matrix of real values: {line[:80]}")
            elif line and not line.startswith("%"):
                rows, columns, entries = map(int, line.split())
                return Header(kind[3], kind[4], (rows, columns), entries, begin)
            elif begin > len(data):
                raise ValueError("a header without sizes")


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.header = read_header(path)

    def partitions(self) -> list[_Range]:
        store, name = _opened(self.path)
        info = store.get_file_info(name)
        whole = [(self.path, self.header.begin, info.size)]
        if info.type == fs.FileType.Directory:
            with store.open_input_stream(f"{name.rstrip('/')}/{HEADER}") as stream:
                listed = [line[7:] for line in stream.read().decode().splitlines() if line.startswith("%parts ")]
            parts = [p for line in listed for p in json.loads(line)]
            whole = [(f"{self.path.rstrip('/')}/{p}", 0, store.get_file_info(f"{name.rstrip('/')}/{p}").size) for p in parts]
        cut = [_Range(p, a, min(end, a + self.split_bytes)) for p, begin, end in whole for a in range(begin, end, self.split_bytes)]
        return cut or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The entries whose lines begin in the range; a line that reaches over its end is read whole."""
        if partition.end <= partition.begin:
            return
        store, name = _opened(partition.path)
        pattern, symmetry = self.header.field == "pattern", self.header.symmetry
        with store.open_input_file(name) as file:
            # a line begins in the range if the byte before it, its line end, is at begin - 1 or later
            first = partition.begin == 0 or partition.begin == self.header.begin and partition.path == self.path
            at = partition.begin if first else partition.begin - 1
            file.seek(at)
            rest, skipping = b"", not first
            while at < partition.end or rest:
                data = file.read(1 << 20)
                block = rest + data
                lines = block.split(b"\n")
                rest = lines.pop() if data else b""
                start = at - (len(block) - len(data))
                for line in lines:
                    begins, start = start, start + len(line) + 1
                    if skipping:  # the end of a line that began before
                        skipping = False
                        continue
                    if begins >= partition.end:
                        return
                    parts = line.split()
                    if not parts or parts[0].startswith(b"%"):
                        continue
                    row, col, value = int(parts[0]) - 1, int(parts[1]) - 1, 1.0 if pattern else float(parts[2])
                    yield row, col, value
                    if symmetry != "general" and row != col:
                        yield col, row, -value if symmetry == "skew-symmetric" else value
                at += len(data)
                if not data:
                    return


@dataclass
class _Part(WriterCommitMessage):
    name: str
    entries: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, shape: tuple[int, int], overwrite: bool):
        self.path, self.shape = path.rstrip("/"), shape
        store, name = _opened(self.path)
        if store.get_file_info(name).type != fs.FileType.NotFound and not overwrite:
            raise ValueError(f"{path} is there already")
        store.create_dir(name, recursive=True)

    def write(self, rows: Iterator) -> _Part:
        """A file of its own for each attempt of a task: only those that are committed are listed."""
        store, folder = _opened(self.path)
        name, entries = f"part-{uuid.uuid4().hex}.mtx", 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            held = []
            for row in rows:
                held.append(f"{row[0] + 1} {row[1] + 1} {row[2]!r}\n")
                entries += 1
                if len(held) == 10_000:
                    out.write("".join(held).encode())
                    held = []
            out.write("".join(held).encode())
        return _Part(name, entries)

    def commit(self, messages: list[_Part]) -> None:
        store, folder = _opened(self.path)
        done = [m for m in messages if m is not None]
        rows, columns = self.shape
        listed = "".join(f"%parts {json.dumps([m.name for m in done[k : k + 50]])}\n" for k in range(0, len(done), 50))
        head = f"%%MatrixMarket matrix coordinate real general\n{listed}{rows} {columns} {sum(m.entries for m in done)}\n"
        with store.open_output_stream(f"{folder}/{HEADER}.tmp") as out:
            out.write(head.encode())
        store.move(f"{folder}/{HEADER}.tmp", f"{folder}/{HEADER}")

    def abort(self, messages: list[_Part]) -> None:
        store, folder = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


class MatrixMarket(DataSource):
    """format("matrixmarket"): row, col and val of a coordinate file; options path, split_bytes, and rows and columns to write."""

    @classmethod
    def name(cls) -> str:
        return "matrixmarket"

    def schema(self) -> str:
        return "row long, col long, val double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], (int(self.options["rows"]), int(self.options["columns"])), overwrite)


def read(spark: SparkSession, path: str, fmt: str = "coo", split_bytes: int = SPLIT_BYTES) -> SparseFrame:
    """A matrix from a file or folder; entries that a file repeats stay repeated."""
    spark.dataSource.register(MatrixMarket)
    shape = read_header(path).shape
    out = SparseFrame(spark.read.format("matrixmarket").option("split_bytes", split_bytes).load(path), shape, "coo")
    return out if fmt == "coo" else SparseFrame(out.coalesce().df, shape, fmt, coalesced=True)


def write(a: SparseFrame, path: str, overwrite: bool = False) -> None:
    """Writes the stored cells of a matrix into a folder."""
    if a.ndim != 2:
        raise ValueError("only a matrix has a MatrixMarket file")
    a.spark.dataSource.register(MatrixMarket)
    rows: DataFrame = a.df.select(*a.coords, "val")
    out = rows.write.format("matrixmarket").option("rows", a.shape[0]).option("columns", a.shape[1])
    out.mode("overwrite" if overwrite else "append").save(path)

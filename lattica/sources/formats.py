"""Data sources for alignment and parameter files: ``format("fasta")`` and ``format("pair_parameters")``.

Tasks open files themselves, by byte ranges, through Arrow's file systems (local and mounted paths, hdfs://, s3://, gs://).
A FASTA file is cut into ranges of ``range_bytes``; a task reads the records that begin in its range. A parameter file has
fixed places for all its numbers: tasks write runs of them as parts, and the commit joins the parts by
their places. Neither rows nor vectors pass through the driver's Python.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_BLOCK = 1 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """Files and sizes, by name, of a file or a folder."""
    system, plain = _system(path)
    info = system.get_file_info(plain)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(plain)) if x.is_file and not x.base_name.startswith((".", "_"))]
    return sorted((x.path, x.size) for x in found)


# FASTA -----------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def records(read, start: int, end: int, size: int, block: int = _BLOCK) -> Iterator[tuple[int, str, str]]:
    """(position, name, sequence) of the records that begin in start..end of a file of ``size`` bytes; ``read(at, n)`` gives its bytes.
    A record begins with ``>`` at the start of a line; white space at line ends and empty lines are passed over."""
    position = name = None
    body: list[bytes] = []
    # a range that begins inside a line leaves that line to the one before
    at = max(0, start - 1)
    held, line_at, skip = b"", at, start > 0
    while True:
        block_bytes = read(at, min(block, size - at)) if at < size else b""
        at += len(block_bytes)
        held += block_bytes
        lines = held.split(b"\n")
        held = lines.pop() if block_bytes else b""
        for line in lines:
            own, line_at = line_at, line_at + len(line) + 1
            if skip:
                skip = False
                continue
            if line.startswith(b">"):
                if position is not None:
                    yield position, name, b"".join(body).decode()
                    position = None
                if own >= end:
                    return
                position, name, body = own, line[1:].rstrip().decode(), []
            elif position is not None:
                body.append(line.strip())
            elif start == 0 and line.strip():
                raise ValueError("a record begins with >")
        if not block_bytes:
            break
    if position is not None:
        yield position, name, b"".join(body).decode()


class FastaSource(DataSource):
    """Option ``range_bytes``: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, position bigint, name string, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("range_bytes", 64 << 20))

    def partitions(self) -> list[Range]:
        return [Range(f, at, min(size, at + self.bytes)) for f, size in _files(self.path) for at in range(0, size, self.bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        with system.open_input_file(partition.file) as f:
            out, held = [], 0
            for position, name, seq in records(lambda at, n: f.read_at(n, at), partition.start, partition.end, f.size()):
                out.append((partition.file, position, name, seq))
                held += len(seq)
                if held > _BLOCK:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "position", "name", "seq"])


# Parameter files ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Places:
    """Where a parameter file has what: header, letters, neighbours, focus, offsets, then fi, hi, fij, eij (32-bit floats)."""

    n_sites: int
    q: int
    n_rows: int  # kept and skipped sequences

    @property
    def fields(self) -> int:
        return 40 + self.q + 4 * self.n_rows + 5 * self.n_sites

    @property
    def pairs(self) -> int:
        return self.fields + 8 * self.n_sites * self.q

    @property
    def n_pairs(self) -> int:
        return self.n_sites * (self.n_sites - 1) // 2

    @property
    def size(self) -> int:
        return self.pairs + 8 * self.n_pairs * self.q**2

    def pair(self, i, j):
        """Place of the pair i < j (from 1) in the order of the file; numbers or columns."""
        return (i - 1) * self.n_sites - i * (i - 1) / 2 + (j - i) - 1


@dataclass
class Part(WriterCommitMessage):
    files: list[tuple[int, str, int]]


class ParameterSource(DataSource):
    """Reads the option ``table`` (fields, couplings, sites, neighbors or header) of a file, and writes rows (place, data)."""

    @classmethod
    def name(cls) -> str:
        return "pair_parameters"

    def schema(self) -> str:
        return {
            "fields": "i int, a int, f float, h float", "couplings": "i int, j int, a int, b int, f float, e float", "sites": "i int, letter string, offset int",
            "neighbors": "s bigint, n float",
            "header": "n_sites int, n_codes int, n_seqs int, n_skipped int, max_iter int, theta float, lambda_h float, lambda_e float, lambda_group float, n_eff float, letters string",
        }[self.options.get("table", "couplings")]

    def reader(self, schema) -> ParameterReader:
        return ParameterReader(self.options)

    def writer(self, schema, overwrite: bool) -> ParameterWriter:
        return ParameterWriter(self.options["path"], int(self.options["size"]))


class ParameterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table, self.bytes = options["path"], options.get("table", "couplings"), int(options.get("range_bytes", 16 << 20))

    def _header(self) -> tuple[tuple, Places]:
        system, plain = _system(self.path)
        with system.open_input_file(plain) as f:
            values = struct.unpack("=5i5f", f.read(40))
        return values, Places(values[0], values[1], values[2] + values[3])

    def partitions(self) -> list[Range]:
        _, s = self._header()
        n, width = {"couplings": (s.n_pairs, s.q**2), "fields": (s.n_sites, s.q), "neighbors": (s.n_rows, 1)}.get(self.table, (1, 1))
        step = max(1, self.bytes // (4 * width))
        return [Range(self.path, at, min(n, at + step)) for at in range(0, n, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        values, s = self._header()
        system, plain = _system(self.path)
        lo, hi, q = partition.start, partition.end, s.q
        with system.open_input_file(plain) as f:
            def numbers(at: int, n: int, kind: str = "=f4") -> np.ndarray:
                return np.frombuffer(f.read_at(4 * n, at), kind)

            if self.table == "couplings":
                count = (hi - lo) * q * q
                i, j = self._sites(s, lo, hi)
                k, a, b = np.indices((hi - lo, q, q)).reshape(3, -1)
                half = 4 * s.n_pairs * q * q
                columns = [i[k], j[k], a, b, numbers(s.pairs + 4 * lo * q * q, count), numbers(s.pairs + half + 4 * lo * q * q, count)]
                names = ["i", "j", "a", "b", "f", "e"]
            elif self.table == "fields":
                i, a = np.indices((hi - lo, q)).reshape(2, -1)
                columns = [i + lo + 1, a, numbers(s.fields + 4 * lo * q, len(a)), numbers(s.fields + 4 * (s.n_sites + lo) * q, len(a))]
                names = ["i", "a", "f", "h"]
            elif self.table == "neighbors":
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(numbers(40 + q + 4 * lo, hi - lo))], names=["s", "n"])
                return
            elif self.table == "sites":
                at = 40 + q + 4 * s.n_rows
                letters = f.read_at(s.n_sites, at).decode("latin-1")
                columns = [np.arange(1, s.n_sites + 1), numbers(at + s.n_sites, s.n_sites, "=i4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].astype(np.int32)), pa.array(list(letters)), pa.array(columns[1].astype(np.int32))], names=["i", "letter", "offset"])
                return
            else:
                names = ["n_sites", "n_codes", "n_seqs", "n_skipped", "max_iter", "theta", "lambda_h", "lambda_e", "lambda_group", "n_eff", "letters"]
                kinds = [pa.int32()] * 5 + [pa.float32()] * 5 + [pa.string()]
                row = [*values, f.read_at(q, 40).decode("latin-1")]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
                return
        whole = [c.astype(np.int32) if c.dtype.kind == "i" else c.astype(np.float32) for c in columns]
        for at in range(0, len(whole[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in whole], names=names)

    @staticmethod
    def _sites(s: Places, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Sites (from 1) of the pairs lo..hi in the order of the file."""
        ends = np.cumsum(np.arange(s.n_sites - 1, 0, -1))
        k = np.arange(lo, hi)
        i = np.searchsorted(ends, k, side="right")
        return i + 1, k - (ends[i] - (s.n_sites - 1 - i)) + i + 2


class ParameterWriter(DataSourceArrowWriter):
    """Rows (place, data), sorted inside each task: runs without a hole become one part file."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.job = path, size, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, plain = _system(self.path)
        files, out, end = [], None, -1
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or place != end:
                    if out is not None:
                        out.close()
                    name = f"{plain}.part-{self.job}-{place:020d}-{uuid.uuid4().hex}"  # attempts of a task don't share a name
                    out, end = system.open_output_stream(name), place
                    files.append([place, name, 0])
                out.write(data)
                end += len(data)
                files[-1][2] += len(data)
        if out is not None:
            out.close()
        return Part([tuple(x) for x in files])

    def commit(self, messages: list[Part | None]) -> None:
        system, plain = _system(self.path)
        parts, end = sorted(x for m in messages if m is not None for x in m.files), 0
        for place, _, size in [*parts, (self.size, "", 0)]:
            if place != end:
                raise ValueError(f"bytes {end} to {place} are missing or written twice")
            end = place + size
        with system.open_output_stream(plain) as out:
            for _, name, _ in parts:
                with system.open_input_stream(name) as f:
                    while block := f.read(_BLOCK):
                        out.write(block)
        self._clear(messages)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(messages)

    def _clear(self, messages: list[Part | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            for _, name, _ in m.files if m is not None else ():
                if system.get_file_info(name).type != fs.FileType.NotFound:
                    system.delete_file(name)


def register(spark: SparkSession) -> None:
    for source in (FastaSource, ParameterSource):
        spark.dataSource.register(source)


@dataclass(frozen=True)
class Header:
    """The numbers at the front of a parameter file."""

    n_sites: int
    n_seqs: int
    n_skipped: int
    max_iter: int
    theta: float
    lambda_h: float
    lambda_e: float
    lambda_group: float
    n_eff: float
    letters: str
    focus: str
    offsets: tuple[int, ...]


def write_parameters(header: Header, neighbors: DataFrame, fields: DataFrame, couplings: DataFrame, path: str) -> None:
    """A parameter file from tables: ``neighbors`` (s, n) of all sequences, numbered from 0; ``fields`` (i, a, f, h) and ``couplings``
    (i, j, a, b, f, e), all cells, sites from 1. Every row becomes bytes at its place; ranges of places are written side by side."""
    spark, q = neighbors.sparkSession, len(header.letters)
    s = Places(header.n_sites, q, header.n_seqs + header.n_skipped)
    front = struct.pack("=5i5f", s.n_sites, q, header.n_seqs, header.n_skipped, header.max_iter, header.theta, header.lambda_h, header.lambda_e, header.lambda_group, header.n_eff)
    front += header.letters.encode("latin-1")
    middle = header.focus.encode("latin-1") + np.array(header.offsets, "=i4").tobytes()
    fixed = spark.createDataFrame([(0, bytearray(front)), (40 + q + 4 * s.n_rows, bytearray(middle))], "place bigint, data binary")

    def cells(rows: DataFrame, keys: list[str], value: str, cell, place) -> DataFrame:
        """Numbers of a site or pair, by code, as one row."""
        grouped = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(cell.alias("c"), F.col(value).cast("float").alias("v")))), lambda x: x["v"]).alias("v"))
        return grouped.select(place.cast("long").alias("place"), "v")

    pair = s.pair(F.col("i").cast("long"), F.col("j").cast("long"))
    width, half = 4 * q * q, 4 * s.n_pairs * q * q
    parts = [neighbors.select((F.lit(40 + q) + 4 * F.col("s")).cast("long").alias("place"), F.array(F.col("n").cast("float")).alias("v"))]
    for value, at in (("f", s.fields), ("h", s.fields + 4 * s.n_sites * q)):
        parts.append(cells(fields, ["i"], value, F.col("a"), F.lit(at) + (F.col("i") - 1) * 4 * q))
    for value, at in (("f", s.pairs), ("e", s.pairs + half)):
        parts.append(cells(couplings, ["i", "j"], value, F.col("a") * q + F.col("b"), F.lit(at) + pair * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(v, "=f4").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["place", "data"])

    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    rows = rows.mapInArrow(pack, "place bigint, data binary").union(fixed)
    register(spark)
    rows.repartitionByRange("place").sortWithinPartitions("place").write.format("pair_parameters").option("size", s.size).mode("append").save(path)

"""Writing models: text, binary and JSON."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.objective import Shape

#: Alphabet order of logos and matrices, by physical and chemical kind; fixed value.
GROUPED_LETTERS = "DEKRHQNSTPGAVILMCFYW"


def _lines(rows: DataFrame, pattern: str) -> DataFrame:
    """One text column in the C formats, which the JVM's formatter rounds differently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([pattern % v for v in values], pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def coupling_lines(table: DataFrame) -> DataFrame:
    """Lines ``i a_i j a_j 0 score`` by i and j."""
    return _lines(table.orderBy("i", "j").select("i", "a_i", "j", "a_j", "zero", "score"), "%d %s %d %s %d %f")


def weight_lines(weights: DataFrame, single: bool = False) -> DataFrame:
    """One weight per raw row, 0.0 for dropped ones, in row order."""
    rows = weights.orderBy("s").select("weight")
    full = "%.8e" if single else "%.16e"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = ["0.0" if not w else full % w for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_parts(lines: DataFrame, folder: str) -> dict:
    """``lines`` (value), in the order of its partitions, as part files of ``folder``, and a manifest: the files in that order
    and how many lines they have. Only the manifest passes through the driver."""
    spark = lines.sparkSession
    lines.write.text(folder)
    system, path = _hadoop(spark, folder)
    names = sorted(f.getPath().getName() for f in system.listStatus(path) if f.getPath().getName().startswith("part-"))
    counts = {r.name: r["count"] for r in spark.read.text(folder).groupBy(F.col("_metadata.file_name").alias("name")).count().collect()}
    manifest = {"lines": sum(counts.values()), "parts": [{"file": n, "lines": counts[n]} for n in names if n in counts]}
    out = system.create(_path(spark, f"{folder}/_manifest.json"))
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, value): the lines of :func:`write_parts`; a folder whose files aren't those of its manifest is an error."""
    system, _ = _hadoop(spark, folder)
    stream = system.open(_path(spark, f"{folder}/_manifest.json"))
    manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    rows = spark.read.text([f"{folder}/{p['file']}" for p in manifest["parts"]]) if manifest["parts"] else spark.createDataFrame([], "value string")
    if manifest["parts"]:
        place = {p["file"]: k for k, p in enumerate(manifest["parts"])}
        found = {r.name: r["count"] for r in rows.groupBy(F.col("_metadata.file_name").alias("name")).count().collect()}
        if found != {p["file"]: p["lines"] for p in manifest["parts"]}:
            raise ValueError("the files of " + folder + " aren't those of its manifest")
        listed = spark.createDataFrame(sorted(place.items()), "name string, part int")
        return rows.withColumn("name", F.col("_metadata.file_name")).join(F.broadcast(listed), "name").select("part", "value")
    return rows.select(F.lit(0).alias("part"), "value")


def write_text(lines: DataFrame, path: str) -> None:
    """One file of ``lines`` in the order of its partitions: written as parts by the tasks and joined by the file system's
    streams, so that no row reaches the driver's Python."""
    spark = lines.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    manifest = write_parts(lines, folder)
    system, target = _hadoop(spark, path)
    system.setWriteChecksum(False)  # a plain file, without one of sums beside it
    out = system.create(target, True)
    try:
        for part in manifest["parts"]:
            source = system.open(_path(spark, f"{folder}/{part['file']}"))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    finally:
        out.close()
        system.setWriteChecksum(True)
        system.delete(_path(spark, folder), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    found = _path(spark, path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


@dataclass
class Parameters:
    """Contents of a parameter file; matrices are float32 as stored."""

    n_seqs: int
    n_skipped: int
    max_iter: int
    theta: float
    lambda_h: float
    lambda_e: float
    lambda_group: float
    n_eff: float
    letters: str
    neighbors: np.ndarray
    focus: str
    offsets: np.ndarray
    fi: np.ndarray  # (sites, q)
    hi: np.ndarray
    fij: np.ndarray | None  # (pairs, q, q), None in a file of sites alone
    eij: np.ndarray | None

    @property
    def shape(self) -> Shape:
        return Shape(*self.fi.shape)


def write_parameters(p: Parameters, path: str) -> None:
    """Sections one after another in native byte order: five integers, five floats, letters,
    neighbour counts, focus letters, offsets, then fi, hi, fij and eij."""
    n_sites, q = p.fi.shape
    with Path(path).open("wb") as f:
        f.write(struct.pack("=5i", n_sites, q, p.n_seqs, p.n_skipped, p.max_iter))
        f.write(struct.pack("=5f", p.theta, p.lambda_h, p.lambda_e, p.lambda_group, p.n_eff))
        f.write(p.letters.encode("latin-1"))
        f.write(p.neighbors.astype("=f4").tobytes())
        f.write(p.focus.encode("latin-1"))
        f.write(p.offsets.astype("=i4").tobytes())
        for x in (p.fi, p.hi, p.fij, p.eij):
            if x is not None:
                f.write(x.astype("=f4").tobytes())


def read_parameters(path: str) -> Parameters:
    data = memoryview(Path(path).read_bytes())
    n_sites, q, n_seqs, n_skipped, max_iter, *floats = struct.unpack_from("=5i5f", data)
    at = 40

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    letters = take(q, "S1").tobytes().decode("latin-1")
    neighbors = take(n_seqs + n_skipped, "=f4")
    focus = take(n_sites, "S1").tobytes().decode("latin-1")
    offsets = take(n_sites, "=i4")
    fi, hi = take(n_sites * q, "=f4").reshape(n_sites, q), take(n_sites * q, "=f4").reshape(n_sites, q)
    fij = eij = None
    if at < len(data):
        pairs = n_sites * (n_sites - 1) // 2
        fij, eij = (take(pairs * q * q, "=f4").reshape(pairs, q, q) for _ in range(2))
    return Parameters(n_seqs, n_skipped, max_iter, *floats, letters, neighbors, focus, offsets, fi, hi, fij, eij)


def parameter_tables(spark, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Fields (i, a, f, h) and couplings (i, j, a, b, f, e) of a parameter file."""
    i, a = (x.ravel().astype(np.int32) for x in np.indices(p.fi.shape))
    fields = pa.table({"i": i + 1, "a": a, "f": p.fi.ravel(), "h": p.hi.ravel()})
    k, b, c = (x.ravel().astype(np.int32) for x in np.indices(p.eij.shape))
    s = p.shape
    pairs = pa.table({
        "i": (s.i[k] + 1).astype(np.int32), "j": (s.j[k] + 1).astype(np.int32), "a": b, "b": c, "f": p.fij.ravel(), "e": p.eij.ravel()})
    return spark.createDataFrame(fields), spark.createDataFrame(pairs)


def neighbor_column(weights: DataFrame, scale: float, compat: bool) -> np.ndarray:
    """Neighbours of each raw row from its weight, 0 for dropped rows; ``compat`` divides by
    the scale once more, as parameter files of the reference do."""
    w = np.array([r.weight for r in weights.orderBy("s").toLocalIterator()])
    out = np.zeros(len(w))
    out[w > 0] = (1 if compat else scale * scale) / (w[w > 0] * scale)
    return out


def export_json(p: Parameters, scores: DataFrame, cutoff: float, share: float = 0.1) -> str:
    """{map, logo, couplings}: letters and numbers of the sites, logo letters by ascending bits,
    and for each pair above the cutoff the rows and columns of its matrix that reach ``share``
    of the model's largest coupling."""
    order = [p.letters.index(c) for c in GROUPED_LETTERS if c in p.letters] or list(range(len(p.letters)))
    order += [k for k in range(len(p.letters)) if k not in order]
    f = p.fi.astype(float)
    entropy = -np.where(f > 0, f * np.log2(np.where(f > 0, f, 1)), 0).sum(axis=1)
    bits = f * (np.log2(f.shape[1]) - entropy)[:, None]
    logo = [
        [{"code": p.letters[k], "bits": round(float(bits[i, k]), 4)} for k in np.argsort(bits[i], kind="stable") if f[i, k] > 0.01]
        for i in range(len(f))
    ]
    least = share * float(np.abs(p.eij).max()) if p.eij.size else 0.0
    at = {(i + 1, j + 1): k for k, (i, j) in enumerate(zip(p.shape.i, p.shape.j, strict=True))}
    couplings = []
    for r in scores.where(F.col("cn") > cutoff).orderBy(F.desc("cn"), "i", "j").collect():
        m = p.eij[at[r.i, r.j]]
        rows = [k for k in order if np.abs(m[k]).max() > least]
        cols = [k for k in order if np.abs(m[:, k]).max() > least]
        couplings.append({
            "i": int(r.i), "j": int(r.j), "score": round(float(r.cn), 6), "iC": "".join(p.letters[k] for k in rows),
            "jC": "".join(p.letters[k] for k in cols), "matrix": [[round(float(m[a, b]), 4) for b in cols] for a in rows],
        })
    return json.dumps({"map": {"letters": p.focus, "indices": [int(x) for x in p.offsets]}, "logo": logo, "couplings": couplings})

"""Binary matrix files: int32 rows, int32 columns, then rows * columns little-endian four-byte values."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that are read in one go, at most.
VALUES = 4 << 20
KINDS = {"float": ("<f4", pa.float32()), "int": ("<i4", pa.int32())}


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a file, and the file's path on it."""
    if urlparse(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), urlparse(uri).path
    return pyarrow.fs.FileSystem.from_uri(uri)


def _heads(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """(file, rows, columns, bytes) of every file at a path (a file, a folder or a pattern), by name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = [spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "*") if s.isDirectory() else s.getPath() for s in store.globStatus(place) or ()]
    files = [s for p in inside for s in store.globStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    found = []
    for status in sorted(files, key=lambda s: s.getPath().toString()):
        stream = store.open(status.getPath())
        head = bytes(stream.readNBytes(8))
        stream.close()
        n, d = np.frombuffer(head, "<i4").tolist() if len(head) == 8 else (-1, -1)
        if n < 0 or d < 0 or status.getLen() != 8 + 4 * n * d:
            raise ValueError(f"{status.getLen()} bytes don't hold {n} rows of {d}: {status.getPath().toString()}")
        found.append((status.getPath().toString(), n, d, status.getLen()))
    if not found:
        raise FileNotFoundError(path)
    return found


def read(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(vec_id, embedding) of a file, or of all files of a folder or pattern; vec_id numbers the rows of all files, in the order of their names.

    Files may have any size: tasks read stretches of rows. kind is float or int. ValueError if a
    file's size doesn't fit its header.
    """
    dtype, arrow = KINDS[kind]
    files, before = [], 0
    for file, n, d, _ in _heads(spark, path):
        files.append((file, n, d, before, max(1, VALUES // max(1, d))))
        before += n
    table = spark.createDataFrame(files, "file string, n long, d int, before long, step long").where("n > 0")
    stretches = table.withColumn("a", F.explode(F.expr("sequence(0L, n - 1, step)"))).select("file", "n", "d", "before", "step", "a").repartition(max(1, sum(-(-f[1] // f[4]) for f in files)), "file", "a")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _place(row["file"])
                with store.open_input_file(name) as f:
                    some = min(row["step"], row["n"] - row["a"])
                    values = np.frombuffer(f.read_at(4 * some * row["d"], 8 + 4 * row["a"] * row["d"]), dtype)
                offsets = np.arange(some + 1, dtype=np.int32) * row["d"]
                ids = row["before"] + row["a"] + np.arange(some)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values, arrow))], names=["vec_id", "embedding"])

    return stretches.mapInArrow(parse, f"vec_id long, embedding array<{kind}>")


def write(vectors: DataFrame, folder: str, kind: str = "float", files: int | None = None) -> DataFrame:
    """Writes (vec_id, embedding) to files of a folder, in the order of vec_id over their names; returns (file, rows).

    Each task holds its rows and writes one file, under a name of its own until it is whole.
    """
    dtype, _ = KINDS[kind]
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    dealt = (rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "vec_id") if files else rows.repartitionByRange("vec_id")).sortWithinPartitions("vec_id")
    numbered = dealt.select("embedding", F.spark_partition_id().alias("part"))
    if urlparse(folder).scheme in ("", "file"):
        pyarrow.fs.LocalFileSystem().create_dir(urlparse(folder).path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, n, d, part = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(dtype)
            d, part = d or len(values) // batch.num_rows, batch.column(1)[0].as_py()
            if len(values) != batch.num_rows * d:
                raise ValueError("the vectors have different lengths")
            chunks.append(values.tobytes())
            n += batch.num_rows
        if n:
            store, last = _place(posixpath.join(folder, f"part-{part:06d}.bin"))
            own = posixpath.join(posixpath.dirname(last), f".{posixpath.basename(last)}")
            with store.open_output_stream(own) as out:
                out.write(np.array([n, d], "<i4").tobytes())
                for chunk in chunks:
                    out.write(chunk)
            store.move(own, last)
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([n], pa.int64())], names=["file", "rows"])

    done = numbered.mapInArrow(put, "file string, rows long").collect()
    return vectors.sparkSession.createDataFrame([tuple(r) for r in done], "file string, rows long")

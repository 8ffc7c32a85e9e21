"""What the corpus operators share: scratch tables, worker-side files and packed arrays."""

from __future__ import annotations

import posixpath
import struct
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The ASCII white space that separates words, as a Java and DuckDB character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a temporary folder where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return posixpath.join(root, f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage; a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """df settled in as many buckets of the column as it asks for, so that grouping by it moves no row; and how many they are."""
    spark = df.sparkSession
    number = max(shuffle_width(spark), df.rdd.getNumPartitions())
    table, path = f"{name}_{uuid.uuid4().hex}", scratch(spark, name)
    df.write.bucketBy(number, column).option("path", path).saveAsTable(table)
    return spark.table(table), number


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextmanager
def atomic_output(path: str):
    """A writable stream that appears under its name only when complete, so repeated and speculative tasks do no harm."""
    system, target = filesystem(path)
    system.create_dir(posixpath.dirname(target), recursive=True)
    partial = f"{target}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial) as stream:
        yield stream
    system.move(partial, target)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Sorted unsigned 64-bit arrays go in as differences, which take fewer bytes."""
    import zstandard

    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        ascending = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if ascending:
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        head.append(struct.pack("<4s?Q", a.dtype.str[1:].encode(), ascending, len(a)))
        body.append(raw)
    return struct.pack("<B", len(arrays)) + b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(value: bytes) -> list[np.ndarray]:
    import zstandard

    n, at, out = value[0], 1, []
    heads = []
    for _ in range(n):
        heads.append(struct.unpack_from("<4s?Q", value, at))
        at += struct.calcsize("<4s?Q")
    raw, at = zstandard.ZstdDecompressor().decompress(value[at:]), 0
    for kind, ascending, length in heads:
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        size = dtype.itemsize * length
        a = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, length).T.copy().view(dtype).ravel() if length else np.empty(0, dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if ascending else a)
        at += size
    return out

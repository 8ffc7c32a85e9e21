"""Document folders: discovery, shards, order, caps and resumption, before any content is read."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """(doc_key, file_size_bytes, mtime, content) of the PDF files in a folder; columns not used are not read."""
    if urlparse(path).scheme in ("", "file") and not os.path.isdir(urlparse(path).path):
        raise ValueError(f"not a folder: {path}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower())
    return files_of(reader.load(path))


def files_of(rows: DataFrame) -> DataFrame:
    return rows.select(local_path(F.col("path")).alias("doc_key"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def named_files(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The files with these keys, which are paths as discover() gives them; characters with a meaning in patterns are escaped."""
    return files_of(spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", k) for k in keys]))


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def in_shard(key: Column, count: int, index: int) -> Column:
    """Is a key in a shard: the first 32 bits of its SHA-1, modulo the count."""
    if count <= 0 or not 0 <= index < count:
        raise ValueError("shard_index must be in [0, shard_count)")
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % count == index


def todo(docs: DataFrame, *, key: str = "doc_key", shard_count: int = 0, shard_index: int = 0, sort: bool = True, max_files: int = 0, done: DataFrame | None = None) -> DataFrame:
    """Shard, then order, then cap, then what is not done yet. The order of these steps decides which documents a cap takes."""
    if shard_count:
        docs = docs.where(in_shard(F.col(key), shard_count, shard_index))
    if max_files:
        docs = (docs.orderBy(key) if sort else docs).limit(max_files)
    return docs if done is None else not_done(docs, done, [key])


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in `done`; repeated rows stay repeated."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def processed(spark: SparkSession, path: str, keys: dict[str, str] | None = None) -> DataFrame | None:
    """The keys of a summary written before, whatever their status; None if there is none or it lacks a column.

    keys: the names that the summary's columns get; pdf_path as doc_key if not given.
    """
    keys = keys or {"pdf_path": "doc_key"}
    try:
        found = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return found.select(*(F.col(k).alias(v) for k, v in keys.items())) if set(keys) <= set(found.columns) else None


def distinct_keys(rows: DataFrame, key: str = "doi", limit: int = 0) -> DataFrame:
    """Distinct keys that are not empty or 'nan', in order, perhaps the first few."""
    kept = rows.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull() & ~F.col(key).isin("", "nan")).distinct().orderBy(key)
    return kept.limit(limit) if limit else kept

"""Sinks, and the scan of a folder as it fills.

A run takes documents in batches and appends each batch's findings first and its summary last; a document counts as done
once its summary row is there. Outputs are folders of part files; each CSV part has the header. Each batch of a stream
writes to a folder of its own number, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.scan import FINDINGS, SUMMARY, findings, summary
from palimpsest.sources import api
from palimpsest.sources.extract import extract
from palimpsest.sources.folder import discover, local_path, named_files, not_done, processed, todo
from palimpsest.sources.tables import spread

#: What is kept of an error's text.
ERROR_CHARS = 2000


@dataclass(frozen=True)
class RunResult:
    findings: str
    summary: str
    processed: int
    skipped: int
    errored: int


def summary_path(out: str) -> str:
    root, ext = os.path.splitext(out)
    return f"{root}_paper_summary{ext}"


def csv_text(column: Column, kind: str) -> Column:
    """A value as the CSV files show it: tuples in brackets, True and False, nothing for null."""
    if kind.startswith("array"):
        items = F.array_join(F.transform(column, lambda v: v.cast("string")), ", ")
        return F.when(column.isNull(), F.lit("")).when(F.size(column) == 1, F.concat(F.lit("("), items, F.lit(",)"))).otherwise(F.concat(F.lit("("), items, F.lit(")")))
    if kind == "boolean":
        return F.when(column, F.lit("True")).when(~column, F.lit("False")).otherwise(F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def append(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends the named columns, missing ones empty, others dropped; CSV with a header if the path says so, else Parquet."""
    kinds = dict(df.dtypes)
    if path.endswith(".csv"):
        shown = df.select(*(csv_text(F.col(c), kinds[c]).alias(c) if c in kinds else F.lit("").alias(c) for c in columns))
        shown.write.mode("append").csv(path, header=True, emptyValue="", quote='"', escape='"')
    else:
        df.select(*(F.col(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("append").parquet(path)


def _written(documents: DataFrame, out: str, preset: str) -> int:
    """Findings and summary of some documents, appended in this order; how many documents could not be read."""
    documents = documents.persist()
    found = findings(documents, preset).persist()
    try:
        found.count()  # whatever fails, fails before anything is written
        failed = documents.where("status = 'error'").count()
        append(found.orderBy("doc_key", "emit"), out, FINDINGS[preset])
        append(summary(documents, found, preset), summary_path(out), SUMMARY[preset])
        return failed
    finally:
        found.unpersist()
        documents.unpersist()


def scan_all(rows: list[Row], documents_of: Callable[[list[Row]], DataFrame], failed_row: Callable[[Row, str], DataFrame], out: str, preset: str) -> int:
    """Scans the documents of some rows. Where that fails, halves are tried, down to the one document that gets the error as its status."""
    try:
        return _written(documents_of(rows), out, preset)
    except Exception as e:
        if len(rows) == 1:
            append(failed_row(rows[0], f"{type(e).__name__}: {e}"[:ERROR_CHARS]), summary_path(out), SUMMARY[preset])
            return 1
    half = len(rows) // 2
    return sum(scan_all(part, documents_of, failed_row, out, preset) for part in (rows[:half], rows[half:]))


def run(spark: SparkSession, input_dir: str, *, out: str = "findings.csv", recursive: bool = True, resume: bool = True, max_files: int = 0, shard_count: int = 0, shard_index: int = 0, sort: bool = True, preset: str = "v3", extractor: Callable[[bytes], dict] | None = None, per_batch: int = 5000) -> RunResult:
    """Scans a folder of documents, `per_batch` at a time; what a batch has written stays if the run is stopped."""
    chosen = todo(discover(spark, input_dir, recursive=recursive), shard_count=shard_count, shard_index=shard_index, sort=sort, max_files=max_files).select("doc_key")
    done = processed(spark, summary_path(out)) if resume else None
    left = chosen if done is None else not_done(chosen, done, ["doc_key"])
    total, count, errored = chosen.count(), 0, 0
    failed = lambda r, e: spark.createDataFrame([(r.doc_key, "error", e)], "pdf_path string, status string, error string")
    for rows in _batches(left.orderBy("doc_key") if sort else left, per_batch):
        errored += scan_all(rows, lambda part: extract(spread(named_files(spark, [r.doc_key for r in part])), extractor), failed, out, preset)
        count += len(rows)
    return RunResult(os.path.abspath(out), os.path.abspath(summary_path(out)), count, total - count, errored)


def _batches(keys: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows of a table of keys, in order, `size` at a time."""
    rows = keys.toLocalIterator()
    while batch := list(itertools.islice(rows, size)):
        yield batch


def crawl(spark: SparkSession, start: str, end: str, *, outdir: str = "./medrxiv_pdfs", out: str = "findings.csv", pause: float = 0.25, max_papers: int = 0, resume: bool = True, retry: api.Retry = api.SCAN, fetcher: api.Fetcher = api.http, base: str = "", extractor: Callable[[bytes], dict] | None = None, per_batch: int = 1000) -> RunResult:
    """The first generation end to end: preprints of a range of dates are listed, fetched and scanned; every finding and paper carries doi, version and date.

    Papers in the summary already, by doi and version, are skipped. base: the service's address, or a folder of its pages.
    """
    spark.dataSource.register(api.PreprintSource)
    reader = spark.read.format("preprints").options(start=api.checked_date(start), end=api.checked_date(end), max_papers=max_papers)
    listed = (reader.option("base", base) if base else reader).load().dropDuplicates(["doi", "version"]).persist()
    done = processed(spark, summary_path(out), {"doi": "doi", "version": "version"}) if resume else None
    left = listed if done is None else not_done(listed, done.withColumn("version", F.col("version").cast("int")), ["doi", "version"])

    def documents(rows: list[Row]) -> DataFrame:
        papers = spread(spark.createDataFrame(rows, listed.schema))
        got = api.download(papers, outdir, fetcher, pause, retry, content=True)
        return extract(got.withColumn("doc_key", F.coalesce("pdf_path", api.paper_key(F.col("doi"), F.col("version")))).drop("pdf_path"), extractor)

    failed = lambda r, e: spark.createDataFrame([(*r, "error", e)], "doi string, version int, date string, status string, error string")
    total, count, errored = listed.count(), 0, 0
    for rows in _batches(left.orderBy("date", "doi", "version"), per_batch):
        errored += scan_all(rows, documents, failed, out, "v1")
        count += len(rows)
    listed.unpersist()
    return RunResult(os.path.abspath(out), os.path.abspath(summary_path(out)), count, total - count, errored)


def follow(spark: SparkSession, input_dir: str, out: str, checkpoint: str, *, preset: str = "v3", extractor: Callable[[bytes], dict] | None = None, per_batch: int = 1000) -> StreamingQuery:
    """Scans new files as they come, until none is left. Files are taken once, by the checkpoint and by the summary."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(input_dir)
    rows = files.select(local_path(F.col("path")).alias("doc_key"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("mtime"), "content")

    def batch(df: DataFrame, number: int) -> None:
        earlier = processed(df.sparkSession, f"{out}/summary")
        if earlier is not None:
            done = df.sparkSession.read.parquet(f"{out}/summary").where(F.col("batch") != number).select(F.col("pdf_path").alias("doc_key"))
            df = not_done(df, done, ["doc_key"])
        documents = extract(df, extractor).persist()
        found = findings(documents, preset)
        found.select(*FINDINGS[preset]).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        summary(documents, found, preset).write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        documents.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Operator 8: line deduplication over the whole corpus.

A line's key is the line stripped of ASCII white space with A-Z lower-cased, hashed to 128 bits. Keys found in several
documents keep the lines of the smallest doc_id only. Lines travel as hashes: each document's distinct keys are counted
with partial aggregation, the keys a document loses come back to it as one array, and lines are filtered in place, so
their order needs no sort. The text itself is shuffled once.

Defined cases: a null or empty text is one empty line; a row with no doc_id keeps its lines and holds back nobody's;
rows of equal doc_id count as one document; a very long text is split like any other; an empty table gives an empty result; extra columns stay, those named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import settled


BLANK = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """Each line's key; None for a line too short to be dropped."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        line = line.strip(BLANK)
        if len(line) < min_chars or not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(line.lower(), digest_size=16).digest())
    return out


def dropped_keys(df: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(key, lost): the line keys that each document loses, for those that lose any; keys of at least min_docs documents are lost."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = {k for k in keys_of(t.as_py(), min_chars) if k is not None}
                ids += [d] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["d", "k"])

    found = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(lines, "d long, k binary")
    # As a table, so that a line which very many documents have is split over tasks when joined.
    # Of two documents, the smallest and the largest id tell; more are counted, each id once.
    counted = F.lit(2) if min_docs <= 2 else F.count(F.lit(1))
    kinds = found if min_docs <= 2 else found.distinct()
    keepers = kinds.groupBy("k").agg(F.min("d").alias("keeper"), F.max("d").alias("last"), counted.alias("docs")).where(f"keeper < last and docs >= {int(min_docs)}")
    keepers = settled(keepers.select("k", "keeper"), "keepers")
    lost = found.join(keepers, "k").where("d > keeper").select("d", "k")
    return lost.groupBy("d").agg(F.collect_set("k").alias("lost")).withColumnRenamed("d", key)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """df with the kept lines in its text column, and n_lines and n_dropped."""
    name = text
    base = df.drop("n_lines", "n_dropped", "__lost")
    lost = dropped_keys(base, key, text, min_chars=min_chars, min_docs=min_docs).withColumnRenamed("lost", "__lost")
    joined = base.join(lost.hint("shuffle_hash"), key, "left")
    at = joined.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("__lost").schema) + ", n_lines long, n_dropped long"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, drops = [], [], []
            losses = b.column(b.schema.get_field_index("__lost"))
            for t, gone in zip(b.column(at), losses):
                t, gone = t.as_py() or "", gone.as_py()
                lines = t.split("\n")
                if gone:
                    gone = set(gone)
                    kept = [line for line, k in zip(lines, keys_of(t, min_chars)) if k not in gone]
                else:
                    kept = lines
                texts.append("\n".join(kept) if gone else t)
                counts.append(len(lines))
                drops.append(len(lines) - len(kept))
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != "__lost"}
            columns |= {name: pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(drops, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(keep, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND l.doc_id > s.keeper AS gone FROM lines l LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

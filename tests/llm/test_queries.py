"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


def documents():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tmp_path, name):
    queries.queries()[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    names = ", ".join(sorted(c[0] for c in con.sql(f"describe {SQL[name]}").fetchall()))
    con.execute(f"create temp table a as select {names} from '{tmp_path}/out/*.parquet'")
    con.execute(f"create temp table b as select {names} from ({SQL[name]})")
    assert con.sql("select count(*) from a").fetchall() == con.sql("select count(*) from b").fetchall()
    assert con.sql("select * from a except all select * from b").fetchall() == []


@pytest.mark.parametrize(("name", "plain", "columns"), [
    ("op6_substring_dedup", brute.substring, ("n_words", "n_removed", "kept_sha256")),
    ("op8_line_dedup", brute.lines, ("n_lines", "n_dropped", "kept_sha256")),
    ("op10_simhash", brute.simhash, ("fingerprint", "component_id")),
])
def test_against_plain(spark, name, plain, columns):
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.queries()[name](spark, DATA).collect()}
    assert got == plain(documents())


def test_pipeline(spark):
    docs, counts = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    from palimpsest.llm.common import settled

    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = settled(stage(spark, docs, DATA), name)
        if i < 3:
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.columns == columns
        docs = out
        counts.append(out.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]
    items = [t for (t,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall()]
    texts = [r["text"] for r in docs.collect()]
    assert not any(i in t for i in items for t in texts)
    places = docs.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in places)
    assert corpus_pipeline.run(spark, DATA).count() == counts[4]


def test_stages_on_odd_rows(spark, odd, nothing):
    """Null and repeated ids, null texts, repeated rows and other columns: each stage gives its columns, and no row is lost but by its rule."""
    rows = odd.union(odd.where("doc_id = 7").withColumn("text", F.lit("word " * 30 + "some text of many different words that goes on " + " ".join(f"w{i}" for i in range(60)))))
    expected = {"quality_rules": 0, "near_duplicates": 7, "benchmark_leaks": 7, "source_mix": None, "shards": 7}
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, rows, DATA), stage(spark, nothing, DATA)
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "shards":
            assert out.columns == corpus_pipeline.COLUMNS
        if expected[name] is not None and name != "quality_rules":
            assert out.count() == expected[name], name

"""Every registered query with SQL gives the rows of that SQL in an independent engine."""

from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import catalogue, oracle

DATA = Path("/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, tmp_path, name):
    catalogue.queries()[name](spark, str(DATA)).write.parquet(str(tmp_path / "out"))
    found = f"'{tmp_path}/out/*.parquet'"
    names = sorted(c[0] for c in tables.sql(f"describe select * from {found}").fetchall())
    want = sorted(c[0] for c in tables.sql(f"describe {SQL[name]}").fetchall())
    assert names == want
    columns = ", ".join(f'"{c}"' for c in names)
    tables.execute(f"create or replace temp table a as select {columns} from {found}")
    tables.execute(f"create or replace temp table b as select {columns} from ({SQL[name]})")
    assert tables.sql("select count(*) from a").fetchall() == tables.sql("select count(*) from b").fetchall()
    assert tables.sql("select * from a except all select * from b").fetchall() == []


def test_full_scan_on_a_few_documents(spark, tmp_path):
    """The whole scan with the fuzzy rule on, for which SQL takes too long on a whole table."""
    con = duckdb.connect()
    con.execute(f"copy (select * from '{DATA}/documents.parquet' where length(text) < 3000 order by doc_id limit 32) to '{tmp_path}/documents.parquet'")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    columns = "doc_key, source, page, text, text_len, prompty_score, reasons, decode_method, fuzzy_best, fuzzy_template"
    found = [tuple(r) for r in catalogue.queries()["full_scan_v3"](spark, str(tmp_path)).fillna("", ["decode_method"]).select(*columns.split(", ")).collect()]
    want = con.sql(f"select {columns.replace(' text,', ' substr(text, 1, 400),').replace(' text_len', ' length(text)').replace('fuzzy_best, fuzzy_template', 'coalesce(fuzzy_best, 0), fuzzy_template')} from ({oracle.findings_with_fuzzy()})").fetchall()
    assert sorted(found) == sorted(want) and len({r[-1] for r in want}) > 3


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_others_have_rows(spark, name):
    assert catalogue.queries()[name](spark, str(DATA)).count() > 0

"""Every query of the span algebra against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from veilspan.plans import queries as Q


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{t}')")
    return con


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name in Q.ORACLE_SQL:
        want = duck.execute(Q.ORACLE_SQL[name])
        assert got == plain(want.fetchall(), [c[0] for c in want.description])
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 200 and sum(r["redaction_count"] for r in rows) == 17 and not any(r["warnings"] for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["q09_mask_documents", "q41_end_to_end_redact", "q41b_two_phase_redact", "q11b_scan_value_identity", "q10b_scan_redaction_count"])
def test_breaks_and_accents_in_what_is_found(spark, tmp_path, name):
    """An address over two lines, and addresses that differ in an accent only."""
    texts = ["see r. enkeit für schach.\nIebever 24 x", "R. Enkeit\r\nschach 24, b@c.de", "Rua Joao Lima, 24; Rua João Lima, 24; Rua João Lima, 24", "plain", "Rua e\u0301 schach\u2028so 7"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = Q.QUERIES[name](spark, str(tmp_path))
    want = con.execute(Q.ORACLE_SQL[name])
    rows = plain(want.fetchall(), [c[0] for c in want.description])
    assert plain([tuple(r) for r in df.collect()], df.columns) == rows and len(rows) > 1

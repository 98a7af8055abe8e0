"""Every query of the library against its SQL, on sf0.001."""

import math
import os

import duckdb
import pytest

from quire.plans import library, moves, objects, reports, setting, structures  # noqa: F401
from quire.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and not isinstance(v, bool) and str(type(v)) != "<class 'numpy.bool'>":
            return round(float(v), 6)
        return str(v)

    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(value, r)) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_line_diff_finds_the_dropped_line(spark):
    """Pages are paired by number, and line numbers are kept, so a dropped line is one removed line."""
    got = {(r["doc_id"], r["page_no"]): r for r in QUERIES["compare_line_diff"](spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        lines = d["text"].split("\n")
        if d["doc_id"] % 35 and d["doc_id"] % 5 == 0 and len(lines) >= 3:
            r = got[d["doc_id"], 1]
            assert len(r["removed"]) == 1 and not len(r["added"])

"""The driver contract: queries of the tables against DuckDB on the smallest data, and the command line."""

import math
import os

import pytest

import __spark_entry__ as entry
from gridlace import __main__ as cli
from gridlace.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return None if isinstance(v, float) and math.isnan(v) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for s in catalog.SOURCES.values():
        con.sql(f"CREATE VIEW {s.table} AS SELECT * FROM '{SF}/{s.table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.endswith(("_em", "_cu")) or n in ("csr_view_ev", "dense_matrix_ev", "load_qv_filter_li", "halo_tile_ev", "bin_labels_ev")))
def test_against_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    want = tables.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert ordered(df.select(*cols).collect()) == ordered(want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_query_is_named(spark):
    assert set(ORACLES) <= set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert entry.entry(spark).columns == ["bx", "by", "gene", "n"]


def test_command_line(spark, tmp_path, capsys):
    at = tmp_path / "p.csv"
    at.write_text("x,y,gene\n0,0,A\n1,1,B\n12,1,A\n")
    cli.main(["--input", str(at), "--output", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "molecules: 3" in said and "active bins: 2" in said and "adjacency entries: 2" in said
    assert spark.read.parquet(str(tmp_path / "out" / "counts")).count() == 3

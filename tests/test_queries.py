"""Every query of the library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from freshet.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: [str(x) if not isinstance(x, float) else f"{x:.5f}" for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    found = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    wanted = con.execute(ORACLE[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    one, two = _rows(found.collect(), found.columns), _rows(wanted.fetchall(), names)
    assert len(one) == len(two) > 0
    for a, b in zip(one, two, strict=True):
        for x, y in zip(a, b, strict=True):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) and y is not None else x == y, (a, b)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

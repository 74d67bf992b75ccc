"""Every registered grid query equals its SQL on the smallest tables, and the package works without its optional part."""

import glob
import math
import os
import subprocess
import sys

import pytest


from rastra.plans.deeper import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")


def plain(rows):
    def value(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns])
    if name not in ORACLE_SQL:
        rows.collect()
        return
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(rows.collect()) == plain([[r[i] for i in at] for r in want.fetchall()])


def test_entry_module_works_without_the_optional_part():
    code = f"""
import sys
class Block:
    def find_spec(self, name, *a):
        if name.startswith(("rastra.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()) and "grid_metric" in e.queries() and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True)

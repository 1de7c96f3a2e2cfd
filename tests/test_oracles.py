"""Every registered query of the knowledge base against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from textkb.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(r[k]) for k in names]) for r in table.to_pylist())


#: Queries of one shape share an operator: one of each shape is run here, all of them by the driver.
SHAPES = ("ing_12_", "ing_14_", "view_", "dq_")
NAMES, _seen = [], {}
for _n in registry.QUERIES:
    _shape = next((s for s in SHAPES if _n.startswith(s)), _n)
    _seen[_shape] = _seen.get(_shape, 0) + 1
    if _seen[_shape] <= 3:
        NAMES.append(_n)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toArrow()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.execute(registry.ORACLES[name]).to_arrow_table())


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

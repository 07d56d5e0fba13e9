"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(str([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in plain.values.tolist())


QUERIES, ORACLES = registry.QUERIES | registry.FIXTURES, registry.ORACLES | registry.FIXTURE_ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(mine.columns)
        assert columns == sorted(want.columns)
        assert _rows(mine, columns) == _rows(want, columns)


def test_names_and_import_without_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not set(registry.FIXTURES) & set(entry.queries()) and len(registry.FIXTURES) == 99

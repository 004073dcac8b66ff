"""Every query against its oracle SQL; queries without one must give rows with a stable schema."""
import oracle
import pytest

from tidewin.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_oracle(name, spark, small, con):
    assert oracle.differences(spark, con, small, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_twice_alike(name, spark, small):
    """Queries without SQL: rows, and the same ones when run again."""
    rows = []
    for _ in range(2):
        df = QUERIES[name](spark, small)
        rows.append((df.schema, oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])))
    assert rows[0] == rows[1]
    assert rows[0][1][1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())

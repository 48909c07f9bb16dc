import pytest

from riskframe import fixtures
from riskframe.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", shuffle_partitions=4, app="riskframe-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def txn(spark):
    return fixtures.txn(spark, SF).cache()


@pytest.fixture(scope="session")
def txn_orders(spark):
    return fixtures.txn_orders(spark, SF).cache()


@pytest.fixture(scope="session")
def scored(spark):
    return fixtures.scored(spark, SF).cache()


@pytest.fixture(scope="session")
def transactions(spark):
    """Fifty seeded transactions."""
    return spark.sql(
        """SELECT id AS TransactionID, id * 39119 AS TransactionDT, CAST(10 + (id * 7919) % 99000 / 100.0 AS DOUBLE)
             AS TransactionAmt, 1000 + (id * 31) % 7 AS card1, 100 + (id * 17) % 5 AS addr1,
             element_at(array('gmail.com', 'yahoo.com', 'hotmail.com'), CAST(id % 3 + 1 AS INT)) AS P_emaildomain
           FROM range(50)"""
    )


def rows(df, *keys):
    """Rows as dictionaries, sorted by `keys`."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(str(r[k]) for k in keys))


def same(left, right, *keys, tolerance=1e-9):
    """Both DataFrames hold the same rows; floats within a relative tolerance."""
    a, b = rows(left, *keys), rows(right.select(*left.columns), *keys)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for name in x:
            if isinstance(x[name], float) and y[name] is not None:
                assert x[name] == pytest.approx(y[name], rel=tolerance, abs=1e-6), (name, x, y)
            else:
                assert x[name] == y[name], (name, x, y)

import pytest

from quern.plans import oracles, queries
from tests.compare import connect, differences

NAMES = list(queries.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, con, name):
    df = queries.queries()[name](spark, sf_dir)
    if name not in oracles.oracle_sql():
        assert df.count() > 0
        return
    assert not differences(df, con, oracles.oracle_sql()[name])


def test_all_but_the_order_of_another_generator_have_a_twin():
    assert set(NAMES) - set(oracles.oracle_sql()) == {"python_shuffle_places"}
    assert not set(oracles.oracle_sql()) - set(NAMES)

import pytest

from quarrymint.llm import registry
from tests.oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, str(DATA))
    if name in registry.oracle_sql():
        same(df, con, registry.oracle_sql()[name])
    else:
        assert df.count() > 0

import pytest

from tests.oracle import same, sql
from voxelspark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.ORACLE:
        same(got, sql(catalog.ORACLE[name], small))
    else:
        # the smallest volume is nearly empty: no sum in it reaches the seed threshold (tests/test_detect.py has others)
        assert len(got) > 0 or name in ("find_cells", "find_cells_local", "seeds")

"""Every query of the library gives the rows of its SQL, or at least runs."""

from __future__ import annotations

import pytest

from keystrand.plans import catalogue
from tests.compare import SF_DIR, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = of_spark(catalogue.QUERIES[name](spark, SF_DIR))
    if name in catalogue.ORACLE:
        assert found == of_sql(catalogue.ORACLE[name])
    else:
        assert found[1]

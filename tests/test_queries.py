"""Every query outside the training-data subpackage against its SQL in DuckDB."""

import pytest

from extractlab import catalog

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees(spark, db, name):
    assert oracle.difference(catalog.queries()[name](spark, SF), db, catalog.oracle_sql()[name]) == ""

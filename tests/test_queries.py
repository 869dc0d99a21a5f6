"""Every registered query against its SQL on the smallest tables."""

import pytest
from harness import compare, duck

from pantrylens.plans import load_all

QUERIES, ORACLES = load_all()
# Queries that find nothing in the smallest tables: no forecast there is low enough against its stock.
LARGER = {"rule_bundle": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, con, sf_dir):
    if name in LARGER:
        sf_dir, con = LARGER[name], duck(LARGER[name])
    assert compare(name, QUERIES[name](spark, sf_dir), ORACLES[name], con) is None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import os

import pytest

from gradeloom.plans import jobs
from tests.oracle import SMALL, connect, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query_equals_its_sql(spark, name):
    same_rows(jobs.QUERIES[name](spark, SMALL), connect(), jobs.SQL[name])


def test_every_job_has_sql():
    assert set(jobs.QUERIES) == set(jobs.SQL)

"""Every query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__
from checks.compare import compare, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    good, note = compare(spark, connection, SF, name)
    assert good, note


def test_entry(spark):
    assert set(ORACLES) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark)
    assert rows.columns[:3] == ["doc_id", "rank", "answer_text"] and not rows.isEmpty()

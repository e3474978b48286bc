"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from tests import duck

SF = "/root/testdata/sf0.001"
# covered by test_training
TRAINING = {"train_compare", "training_document", "batch_score"}
QUERIES, TWINS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return duck.connect(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_equals_sql(spark, db, name):
    assert duck.compare(spark, db, QUERIES[name], TWINS[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - TRAINING))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_flagship_query(spark):
    df = contract.entry(spark)
    assert df.columns == ["airline", "priority", "tickets", "answered", "total_score"]
    rows = df.collect()
    assert sum(r["tickets"] for r in rows) == 368
    assert {r["priority"] for r in rows} == {"URGENT", "NORMAL"} and len(rows) > 6


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)

import pytest

from quern.llm import registry
from tests.test_plans import SF, compare


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 8)} | {"p6_ids"} <= set(registry.QUERIES)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_columns(spark):
    wanted = {"p1_found": ["keep_id", "row_id"], "p2_found": ["response_id", "defect"], "p4_found": ["row_id_a", "row_id_b"], "p5_found": ["item_id", "field_name", "label"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, columns in wanted.items():
        assert registry.QUERIES[name](spark, str(SF)).columns == columns

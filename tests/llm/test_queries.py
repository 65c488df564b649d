import pytest

from switchyard.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= (0 if name in ("p2_found",) else 1)


def test_columns(spark, sf_dir):
    expected = {"p1_found": ["id_lo", "id_hi"], "p2_found": ["eval_id", "intent_id"], "p5_found": ["row_id_lo", "row_id_hi"], "p9_found": ["doc_id", "sent_start", "sent_end"]}
    for name, columns in expected.items():
        assert QUERIES[name](spark, sf_dir).columns == columns


def test_sql(spark, sf_dir):
    from switchyard.llm.queries import SQL
    from tests.oracle import assert_same

    for name, sql in SQL.items():
        assert_same(QUERIES[name](spark, sf_dir), sf_dir, sql)

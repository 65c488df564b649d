"""Every query of the core that has SQL gives what the SQL gives; the others run."""

import pytest

from switchyard.plans import data_catalogue, detail_catalogue, io_catalogue, prepared, request_catalogue, routing_catalogue, text_catalogue
from tests.oracle import assert_same

QUERIES = text_catalogue.QUERIES | data_catalogue.QUERIES | prepared.QUERIES | routing_catalogue.QUERIES | request_catalogue.QUERIES | io_catalogue.QUERIES | detail_catalogue.QUERIES
SQL = text_catalogue.SQL | data_catalogue.SQL | prepared.SQL | routing_catalogue.SQL | request_catalogue.SQL | io_catalogue.SQL | detail_catalogue.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_one_decision_per_document(spark, sf_dir):
    out = QUERIES["route_pipeline_flagship"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.count() == out.select("doc_id").distinct().count() == docs.count()
    assert out.where("decision is null").count() == 0


def test_wide_form_agrees_with_long_form(spark, sf_dir):
    wide = {r.doc_id: (r.scene, r.score) for r in QUERIES["route_pipeline_flagship"](spark, sf_dir).collect()}
    long = {r.doc_id: (r.top1, r.top1_score) for r in QUERIES["scope_gate_decision"](spark, sf_dir).collect()}
    assert wide == long


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

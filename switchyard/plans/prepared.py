"""Queries of the general data problems: packed fields (3), failing rows (4), orphan references (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import orphans, packed, rawload
from switchyard.plans.prepared_sql import SQL  # noqa: F401 - read by the entry
from switchyard.session import spread, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.explode_packed(table(spark, sf_dir, "seed_cases_template"), "tags", "row_id")


def p3_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = p3_found(spark, sf_dir)
    return tags.groupBy("tag").agg(F.count("*").alias("n_uses"), F.sum(F.when(F.col("pos") == 1, 1).otherwise(0)).alias("n_first"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawload.rejected(spread(table(spark, sf_dir, "seed_cases_raw").select("line_id", "raw_line")), "line_id", "raw_line")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawload.loaded(spread(table(spark, sf_dir, "seed_cases_raw").select("line_id", "raw_line")), "line_id", "raw_line")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = table(spark, sf_dir, "capabilities")
    of = [("seed_cases_template", "row_id", "scene_id"), ("capability_intents", "intent_id", "capability_id")]
    found = [
        orphans.find_orphans(table(spark, sf_dir, name), caps, ref_id, ref_key, "created_at", "capability_id", "created_at", "deleted_at").select(F.lit(name).alias("ref_table"), "*")
        for name, ref_id, ref_key in of
    ]
    return found[0].unionByName(found[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id", "kind")


def p6_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans_by_month(_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_tag_counts": p3_tag_counts, "p4_found": p4_found, "p4_loaded": p4_loaded, "p6_found": p6_found, "p6_by_month": p6_by_month}

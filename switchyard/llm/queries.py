"""Queries over the test tables for the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import confusables, dedup, mixing, overlap, packing, tokens
from switchyard.llm import sentences as sentence_units
from switchyard.session import materialize, spread, table


def _visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = [("network_ops_business_golden_v1", "id", "text"), ("capability_intents", "intent_id", "text"), ("ac_terms", "term_id", "term")]
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), F.col(i).alias("id"), F.col(c).alias("text")) for t, i, c in of]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_alike_pairs(_visible_records(spark, sf_dir), "id", "text")


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.consistent_texts(_visible_records(spark, sf_dir), "text").select("ref_table", "id", "consistent")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_alike_classes(_visible_records(spark, sf_dir), "id", "text")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.look_alike_members(_visible_records(spark, sf_dir), "id", "text")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("network_ops_business_golden_v1", "network_ops_regression_local_fallback_v1")
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select("id", "text", "source", F.lit(t).alias("split")) for t in names])


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    trains = table(spark, sf_dir, "capability_intents").select(F.col("intent_id").alias("id"), "text")
    return overlap.overlaps(_splits(spark, sf_dir), trains)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("eval_id", F.col("intent_id").alias("intent_id"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_splits(spark, sf_dir), _overlaps(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "seed_cases_template"), "row_id", ["case_id", "text"], ["slots_json"])


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapsed(table(spark, sf_dir, "seed_cases_template"), "row_id", ["case_id", "text"], ["slots_json"])


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tokens.sized(spread(table(spark, sf_dir, "documents").select("doc_id", "text", *keep)), "doc_id", "text", None, *keep)


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r.spec_id, r.capacity_tokens) for r in table(spark, sf_dir, "pack_specs").orderBy("spec_id").collect()]


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _specs(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_assignment(spark, sf_dir), _specs(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units.sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, specs = materialize(_sizes(spark, sf_dir)), _specs(spark, sf_dir)
    return packing.violations(packing.pack(sizes, specs), sizes, specs)


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.violations(materialize(_sizes(spark, sf_dir, "source")), table(spark, sf_dir, "mix_targets"))


def p9_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_units.visible_per_document(docs, "doc_id", "text", p9_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent, "p1_classes": p1_classes, "p1_members": p1_members, "p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p7_assignment": p7_assignment, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p7_violations": p7_violations, "p8_violations": p8_violations, "p9_visible": p9_visible}
_FORM = r"lower(upper(regexp_replace(@, '[\s\x{3000}\x{a0}\p{P}]', '', 'g')))"
_GROUPS = f"""
  WITH leaf AS (SELECT s.row_id, list_sort(list(t.fullkey || '=' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || coalesce(CAST(t.atom AS VARCHAR), '') END)) AS slots
    FROM seed_cases_template s, json_tree(s.slots_json) t WHERE t.type <> 'OBJECT' GROUP BY s.row_id),
  rec AS (SELECT s.row_id, {_FORM.replace('@', 's.case_id')} AS c, {_FORM.replace('@', 's.text')} AS t, coalesce(CAST(slots AS VARCHAR), CASE WHEN slots_json IS NOT NULL THEN '[]' END) AS j FROM seed_cases_template s LEFT JOIN leaf USING (row_id)),
  g AS (SELECT row_id, min(row_id) OVER (PARTITION BY c, t, j) AS lo FROM rec)"""
SQL: dict[str, str] = {
    "p5_found": _GROUPS + " SELECT lo AS row_id_lo, row_id AS row_id_hi FROM g WHERE row_id <> lo",
    "p5_collapsed": _GROUPS + ", n AS (SELECT lo AS row_id, count(*) AS n_copies FROM g GROUP BY lo) SELECT s.*, n_copies FROM seed_cases_template s JOIN n USING (row_id)",
    "p7_violations": "SELECT spec_id, CAST(0 AS BIGINT) AS n_above, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_split FROM pack_specs",
    "p8_violations": "SELECT source, CAST(0 AS BIGINT) AS n_above, CAST(0 AS BIGINT) AS n_uneven, false AS off FROM mix_targets",
    "p9_visible": r"""SELECT doc_id, CAST(length(v) AS BIGINT) AS n_visible, CAST(0 AS BIGINT) AS n_bad FROM (SELECT doc_id, regexp_replace(text, '[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') AS v FROM documents) WHERE v <> ''""",
}

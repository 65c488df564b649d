"""Validators of a configuration: its tables as constraints that must give no rows, its small documents as checks by path."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators.seeds import missing_keys
from switchyard.plans.compiler import all_violations, violations

#: Allowed flows and search backends.
FLOWS = ("query", "report", "direct", "unknown")
BACKENDS = ("opensearch", "elasticsearch", "es")
#: Columns that a capability must hold.
CAPABILITY_KEYS = ("capability_id", "description", "keywords", "required_slots")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that a table has not."""
    return [c for c in required if c not in df.columns]


def table_violations(capabilities: DataFrame, intents: DataFrame, seeds: DataFrame) -> DataFrame:
    """rule, key, n of every broken constraint of the tables."""
    lost = missing_columns(capabilities, CAPABILITY_KEYS)
    if lost:
        raise ValueError(f"capabilities have not {lost}")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    within = lambda c: F.concat(F.coalesce("capability_id", F.lit("")), F.lit("/"), F.trim(c))
    incomplete = blank("capability_id")
    for c in CAPABILITY_KEYS[1:]:
        incomplete = incomplete | F.col(c).isNull()
    named = intents.where(~blank("template_id"))
    said = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("label"), F.lit("")), F.lit(""))
    return all_violations(
        violations("capability_keys", capabilities, F.coalesce("capability_id", F.lit("")), bad=incomplete),
        violations("capability_unique", capabilities.where(~blank("capability_id")), F.col("capability_id"), unique=True),
        violations("capability_flow", capabilities, F.col("capability_id"), bad=~F.coalesce(F.lower(F.trim("flow_type")), F.lit("query")).isin(*FLOWS)),
        violations("intent_case", intents, F.col("intent_id"), bad=blank("case_id")),
        violations("intent_unique", intents.where(~blank("case_id")), within("case_id"), unique=True),
        violations("intent_text", intents, F.col("intent_id"), bad=F.length(said) < 2),
        violations("template_unique", named, within("template_id"), unique=True),
        violations("template_scene", missing_keys(named, capabilities, "capability_id", "capability_id"), F.trim("template_id")),
        violations("seed_case", seeds, F.col("row_id"), bad=blank("case_id")),
        violations("seed_scene", missing_keys(seeds, capabilities, "scene_id", "capability_id"), F.col("row_id")),
        violations("seed_text", seeds, F.col("row_id"), bad=F.length(F.trim(F.coalesce("text", F.lit("")))) < 2),
    )


def _share(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1


def _count(x: object, least: int = 1) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= least


def _broken(documents: dict[str, dict]) -> Iterator[tuple[str, str]]:
    """(document, path) of what does not hold."""
    for key, value in documents.get("thresholds", {}).items():
        if not _share(value):
            yield "thresholds", key
    vector = documents.get("vector", {})
    for key in ("scene_topk", "template_topk", "seed_case_topk"):
        if not _count(vector.get(key, 5)):
            yield "vector", key
    if not _count(vector.get("query_vector_cache_size", 1024)):
        yield "vector", "query_vector_cache_size"
    if vector.get("search_backend", "opensearch") not in BACKENDS:
        yield "vector", "search_backend"
    for name, weights in vector.get("fusion_weights", {}).items():
        if abs(sum(weights.values()) - 1.0) > 1e-6:
            yield "vector", f"fusion.{name}"
    guard = vector.get("seed_scope_guard", {})
    if not _share(guard.get("min_score", 0)) or not _count(guard.get("min_hits", 1)) or not isinstance(guard.get("enabled", False), bool):
        yield "vector", "seed_scope_guard"
    prefill = vector.get("param_prefill", {})
    for key in ("commit_score", "min_gap"):
        if not _share(prefill.get(key, 0)):
            yield "prefill", key
    for key in ("max_candidates_per_slot", "min_term_length", "max_matches"):
        if not _count(prefill.get(key, 1)):
            yield "prefill", key
    if not isinstance(prefill.get("domain_penalty", 0.2), (int, float)) or prefill.get("domain_penalty", 0.2) < 0:
        yield "prefill", "domain_penalty"
    embedding = vector.get("embedding", {})
    if embedding and not embedding.get("model"):
        yield "embedding", "model"
    if not _count(embedding.get("dimension", 1)):
        yield "embedding", "dimension"
    if not _count(embedding.get("timeout_ms", 3000), 100):
        yield "embedding", "timeout_ms"
    rules = documents.get("rules", {})
    for key, value in rules.items():
        if key.endswith("_words") and not isinstance(value, list):
            yield "rules", key
    if not _count(rules.get("max_input_chars", 1000)):
        yield "rules", "max_input_chars"


def document_violations(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """rule (the document), key (the path), n of every broken constraint of the small documents."""
    rows = [(rule, key, 1) for rule, key in _broken(documents)]
    return spark.createDataFrame(rows, "rule string, key string, n bigint")

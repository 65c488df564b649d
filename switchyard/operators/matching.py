"""Requests against tables of scenes and templates. Every join is by key; a request without a match is kept or told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.scoring import slot_fit, weighted_score
from switchyard.operators.ranking import top_k
from switchyard.operators.retrieve import lexical_scores
from switchyard.operators.slots import with_defaults
from switchyard.session import is_small

#: Weights of the rule, the vector score and the fit of the slots.
WEIGHTS = (0.35, 0.45, 0.20)
_NONE = "array<string>"


def scenes_of_flow(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """A row per request and scene of its flow_type (blank in a scene: query), or of any if it has none; `_d` refuses, without a scene, if none is left."""
    flow = F.coalesce(F.nullif(F.lower(F.trim("flow_type")), F.lit("")), F.lit("query"))
    there = scenes.withColumn("_flow", flow).drop("flow_type", "enabled", "version", "created_at", "deleted_at")
    there = F.broadcast(there) if is_small(scenes) else there
    r = requests.withColumn("_asked", F.nullif(F.lower(F.trim("flow_type")), F.lit("")))
    given = r.where("_asked is not null").join(there, F.col("_asked") == F.col("_flow"), "left")
    anything = r.where("_asked is null").join(there, F.lit(True), "left")
    out = given.unionByName(anything).drop("_asked", "_flow")
    return out.withColumn("_d", F.when(F.col("scene_id").isNull() & F.col("flow_type").isNotNull(), "refuse:unsupported_domain"))


def with_scene(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every request with required_slots of its scene_id and its slots (a map) filled from the scene's defaults; no scene: nothing required, no defaults. scenes: a row per scene_id."""
    by_id = scenes.select("scene_id", F.col("required_slots").alias("_required"), F.col("defaults").alias("_defaults"))
    nothing = F.map_from_arrays(F.array().cast(_NONE), F.array().cast(_NONE))
    out = requests.join(by_id, "scene_id", "left")
    slots = with_defaults(F.coalesce("slots", nothing), F.coalesce("_defaults", nothing))
    return out.withColumn("slots", slots).withColumn("required_slots", F.coalesce("_required", F.array().cast(_NONE))).drop("_required", "_defaults")


def with_templates(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """A row per request and template of its scene_id."""
    return requests.join(templates, "scene_id")


def with_vector(scored: DataFrame, hits: DataFrame, query: str, item: str) -> DataFrame:
    """scored with `vector`: the best score of the hits (query, item, score) on it; 0 if there is none."""
    best = hits.groupBy(query, item).agg(F.max("score").alias("vector"))
    return scored.join(best, [query, item], "left").withColumn("vector", F.coalesce("vector", F.lit(0.0)))


def rule_score(score: Column, norm: Column, negative: Column) -> Column:
    """0 if a negative keyword occurs."""
    hit = F.exists(negative, lambda w: F.coalesce(F.contains(norm, F.lower(w)), F.lit(False)))
    return F.when(F.coalesce(hit, F.lit(False)), 0.0).otherwise(score)


def best_templates(requests: DataFrame, templates: DataFrame, hits: DataFrame, query: str, norm: str, k: int, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """query, scene_id, template_id, score, rank: the k best templates of each request's scene, by rule, vector hits (query, template_id, score) and fit of the slots."""
    pairs = lexical_scores(with_templates(requests, templates), norm, "keywords", "examples")
    pairs = with_vector(pairs.withColumn("_rule", rule_score(F.col("score"), F.col(norm), F.col("negative_keywords"))), hits, query, "template_id")
    fit = slot_fit(F.col("slots"), F.col("required_slots"), F.col("optional_slots"))
    scored = pairs.withColumn("score", weighted_score(list(zip(weights, (F.col("_rule"), F.col("vector"), fit)))))
    return top_k(scored, [query], [F.round("score", 9).desc(), F.col("template_id")], k).select(query, "scene_id", "template_id", "score", "rank")

"""Slots: maps of name to JSON text. Merging, conditional requirements, policies and what to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.scoring import is_present
from switchyard.functions.text import round_count


def present(slots: Column) -> Column:
    return F.map_filter(slots, lambda k, v: is_present(v))


def overlay(base: Column, new: Column) -> Column:
    """base with the present values of new written over it."""
    fresh = present(new)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def with_defaults(slots: Column, defaults: Column) -> Column:
    """slots with defaults where a value is missing."""
    return overlay(defaults, slots)


def required_slots(required: Column, conditions: list[tuple[str, str, list[str]]], slots: Column) -> Column:
    """required and the slots of each condition (slot, equal to, more slots) that holds, once each, in order."""
    more = [F.when(F.coalesce(F.try_element_at(slots, F.lit(s)) == F.lit(v), F.lit(False)), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for s, v, names in conditions]
    return F.array_distinct(F.concat(required, *more))


def missing(required: Column, slots: Column) -> Column:
    return F.filter(required, lambda s: ~is_present(F.try_element_at(slots, s)))


def applies(condition: Column, slots: Column) -> Column:
    """Whether every slot of the condition (map of slot to allowed values) has an allowed value."""
    return F.forall(F.map_entries(condition), lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at(slots, e["key"])), F.lit(False)))


def policy_value(scene: Column, slot: Column, anything: Column) -> Column:
    """Scene's setting, else the slot's, else that of `*`."""
    return F.coalesce(scene, slot, anything)


def with_policies(asked: DataFrame, policies: DataFrame, values: list[str]) -> DataFrame:
    """asked (scene_id, slot, ...) with each of values from the policy of its scene and slot, else of its slot in any scene, else
    of `*`. policies: scene_id (null: any), slot, values. Each level is a left join by key; the last is one row."""
    out = asked
    levels = [(policies.where("scene_id is not null"), ["scene_id", "slot"]), (policies.where("scene_id is null and slot <> '*'").drop("scene_id"), ["slot"])]
    for n, (level, keys) in enumerate(levels):
        out = out.join(level.select(*keys, *(F.col(v).alias(f"_{n}_{v}") for v in values)), keys, "left")
    anything = policies.where("scene_id is null and slot = '*'").agg(*(F.first(v).alias(f"_2_{v}") for v in values))
    out = out.crossJoin(F.broadcast(anything))
    return out.withColumns({v: policy_value(*(F.col(f"_{n}_{v}") for n in range(3))) for v in values}).drop(*(f"_{n}_{v}" for n in range(3) for v in values))


def has_signal(entities: Column, names: Column) -> Column:
    """Whether any of the named entities (of a map) is there and not blank."""
    return F.coalesce(F.exists(names, lambda n: F.coalesce(F.trim(F.try_element_at(entities, n)) != "", F.lit(False))), F.lit(False))


def coerced_context(context: Column, default_most: int = 2) -> Column:
    """A request's context, JSON of any shape, as a struct: scene and flow_type if they are texts, slots if an object (values as JSON),
    pending_slots if an array, and round counters, 0 and default_most where they are no numbers."""
    v = F.try_parse_json(context)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    text_of = lambda name: F.when(F.schema_of_variant(at(f"$.{name}", "variant")) == "STRING", at(f"$.{name}", "string"))
    slots = F.when(F.coalesce(F.schema_of_variant(at("$.slots", "variant")), F.lit("")).startswith("OBJECT"), F.from_json(F.get_json_object(context, "$.slots"), "map<string,string>"))
    pending = F.when(F.coalesce(F.schema_of_variant(at("$.pending_slots", "variant")), F.lit("")).startswith("ARRAY"), at("$.pending_slots", "array<string>"))
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        text_of("scene").alias("scene"), text_of("flow_type").alias("flow_type"), F.coalesce(slots, empty).alias("slots"), F.coalesce(pending, F.array().cast("array<string>")).alias("pending_slots"),
        round_count(at("$.clarify_round", "string"), 0, 0).alias("clarify_round"), round_count(at("$.max_clarify_round", "string"), 1, default_most).alias("max_clarify_round"),
    )


def ask_score(base: Column, fits: Column, inferable: Column, defaultable: Column, cost: Column) -> Column:
    """Weights as they must be for the same order of questions. Score of asking for a slot: far down if its condition fails, else up if it can be inferred, down for its cost."""
    worth = base + F.when(inferable, 0.4).otherwise(0.0) - F.when(defaultable, 0.1).otherwise(0.0) - 0.2 * cost
    return F.when(fits, worth).otherwise(base - 100.0)


def to_ask(ranked: Column, n: int) -> Column:
    """The first n (at least one) of an array of structs (score, ord, slot), by falling score, then order."""
    best = F.array_sort(ranked, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    return F.transform(F.slice(best, 1, max(1, n)), lambda x: x["slot"])


def clarify_step(n_missing: Column, round_: Column, most: Column) -> Column:
    """complete without missing slots, exhausted at the most rounds, else ask."""
    return F.when(n_missing == 0, "complete").when(round_ >= most, "exhausted").otherwise("ask")


def sorted_text(slots: Column) -> Column:
    """A map as text with sorted entries, for output and grouping."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(slots), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")

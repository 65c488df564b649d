"""Configuration compiled into dimension tables, and its constraints as queries that must be empty."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions.text import clean_list, first_non_blank
from switchyard.sources.readers import capability_list, load_config


def _field(df: DataFrame, path: str, kind: str) -> Column:
    """A column or a field of a struct; null if the frame has none."""
    at = df.schema
    for part in path.split("."):
        if part not in getattr(at, "names", []):
            return F.lit(None).cast(kind)
        at = at[part].dataType
    return F.col(path)


def _list(df: DataFrame, path: str) -> Column:
    return clean_list(_field(df, path, "array<string>"))


def _template_id(intents: DataFrame) -> Column:
    return F.coalesce(first_non_blank(_field(intents, "template.template_id", "string")), _field(intents, "template_id", "string"))


def _top_level(schema: str) -> list[str]:
    """Fields of a schema text, cut at the commas outside of brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def scenes(capabilities: DataFrame) -> DataFrame:
    """Enabled capabilities as scenes, with their defaults; lists trimmed and without blanks."""
    c = capabilities.where(F.coalesce(F.col("enabled"), F.lit(True)))
    return c.select(
        F.col("capability_id").alias("scene_id"), F.coalesce("description", F.lit("")).alias("description"), F.lower(F.coalesce("flow_type", F.lit("query"))).alias("flow_type"), F.coalesce("router_priority", F.lit(50)).alias("router_priority"),
        *(clean_list(F.col(x)).alias(x) for x in ("entry_phrases", "keywords", "required_slots")), "version", "created_at", "deleted_at",
    )


def seeds(intents: DataFrame) -> DataFrame:
    """Intents as seeds: text from text, first example, label or case; route from the intent, else by whether it has a template."""
    route = first_non_blank(F.col("route_type"), F.when(_template_id(intents).isNotNull(), "route_template").otherwise("route_nl2sql"))
    return intents.where(F.coalesce(F.col("enabled"), F.lit(True))).select(
        "intent_id", "case_id", F.col("capability_id").alias("scene_id"), first_non_blank(F.col("text"), F.get(_list(intents, "examples"), F.lit(0)), F.col("label"), F.col("case_id")).alias("text"), route.alias("route_type"), clean_list(F.col("tags")).alias("tags"), F.coalesce("priority", F.lit(100)).alias("priority"), _template_id(intents).alias("template_id")
    )


def templates(intents: DataFrame) -> DataFrame:
    """Templates of the intents that have a case and a template: each value from the nested template, if it says any, else from the intent."""

    def either(name: str) -> Column:
        own = _list(intents, f"template.{name}")
        return F.when(F.size(own) > 0, own).otherwise(_list(intents, name))

    schema = {f: [_list(intents, f"{at}slot_schema.{f}") for at in ("template.", "")] for f in ("required", "optional")}
    own = sum((F.size(own) for own, _ in schema.values()), F.lit(0)) > 0
    out = intents.select(
        first_non_blank(_template_id(intents)).alias("template_id"), F.col("capability_id").alias("scene_id"), first_non_blank(F.col("case_id")).alias("case_id_ref"), *(F.when(own, a).otherwise(b).alias(f"{f}_slots") for f, (a, b) in schema.items()),
        *(either(x).alias(x) for x in ("examples", "keywords", "negative_keywords")), F.coalesce(_field(intents, "template.enabled", "boolean"), F.col("enabled"), F.lit(True)).alias("enabled"),
    )
    return out.where("enabled and template_id is not null and case_id_ref is not null").drop("enabled")


def with_legacy(compiled: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """compiled and the rows of an older list of the same scene whose key no intent has."""
    listed = compiled.select("scene_id", key).distinct()
    return compiled.unionByName(legacy.where(first_non_blank(F.col(key)).isNotNull()).join(listed, ["scene_id", key], "left_anti"), allowMissingColumns=True)


def cases(capabilities: DataFrame) -> DataFrame:
    """A case for each enabled capability with recommendations: its id or case_{capability}, three examples, the actions."""
    c = capabilities.where(F.coalesce(F.col("enabled"), F.lit(True)) & (F.size("recommendations") > 0))
    case_id = F.coalesce(first_non_blank(_field(c, "recommendation_case_id", "string")), F.concat(F.lit("case_"), F.replace("capability_id", F.lit("."), F.lit("_"))))
    return c.select(case_id.alias("case_id"), F.col("capability_id").alias("scene_id"), F.slice(_list(c, "examples"), 1, 3).alias("examples"), F.col("recommendations").alias("recommended_actions"))


def slot_policies(capabilities: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """scene_id, slot_policy (a map) of the capabilities that have one, enabled or not; the defaults, if given, stand at the scene null."""
    own = capabilities.where(F.size("slot_policy") > 0).select(F.col("capability_id").alias("scene_id"), "slot_policy")
    return own if defaults is None else own.unionByName(defaults.select(F.lit(None).cast("string").alias("scene_id"), "slot_policy"))


def index_documents(scenes_: DataFrame) -> DataFrame:
    """One document per description, phrase and keyword of a scene: id `{scene}_{place}`."""
    texts = F.concat(F.array("description"), F.col("entry_phrases"), F.col("keywords"))
    each = scenes_.select("scene_id", "version", F.posexplode(texts).alias("place", "text")).where("text <> ''")
    return each.select(F.concat_ws("_", "scene_id", F.col("place").cast("string")).alias("doc_id"), "scene_id", "version", "text")


def template_documents(templates_: DataFrame) -> DataFrame:
    """One document per example and keyword of a template: id `{template}_{place}`."""
    each = templates_.select("template_id", "scene_id", F.posexplode(F.concat("examples", "keywords")).alias("place", "text"))
    return each.select(F.concat_ws("_", "template_id", F.col("place").cast("string")).alias("doc_id"), "scene_id", "template_id", "text")


def seed_documents(seeds_: DataFrame) -> DataFrame:
    """One document per seed that has a case: id is the case."""
    return seeds_.select(first_non_blank(F.col("case_id")).alias("doc_id"), "scene_id", "template_id", "text").where("doc_id is not null and text is not null")


def all_index_documents(scenes_: DataFrame, templates_: DataFrame, seeds_: DataFrame) -> DataFrame:
    """kind (scene, template, seed), doc_id, scene_id, template_id, text of all three."""
    parts = {"scene": index_documents(scenes_).withColumn("template_id", F.lit(None).cast("string")), "template": template_documents(templates_), "seed": seed_documents(seeds_)}
    return reduce(DataFrame.unionByName, (d.select(F.lit(kind).alias("kind"), "doc_id", "scene_id", "template_id", "text") for kind, d in parts.items()))


def violations(name: str, df: DataFrame, key: Column, unique: bool = False, bad: Column | None = None) -> DataFrame:
    """Rows (rule, key, n) that break a constraint: a key that is not unique, or rows for which bad holds."""
    rows = df.select(key.cast("string").alias("key"), (bad if bad is not None else F.lit(True)).alias("bad")).where("bad")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    return (counted.where("n > 1") if unique else counted).select(F.lit(name).alias("rule"), "key", "n")


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_none(found: DataFrame, show: int = 5) -> None:
    """Raises ValueError with the first violations."""
    rows = found.orderBy("rule", "key").limit(show).collect()
    if rows:
        raise ValueError("; ".join(f"{r.rule}: {r.key} ({r.n})" for r in rows))


INTENT = "case_id string, label string, text string, route_type string, tags array<string>, priority int, enabled boolean, template_id string, examples array<string>, keywords array<string>, negative_keywords array<string>, template struct<template_id:string,examples:array<string>,keywords:array<string>,negative_keywords:array<string>,enabled:boolean,slot_schema:struct<required:array<string>,optional:array<string>>>"
CAPABILITY = f"capability_id string, flow_type string, router_priority int, description string, entry_phrases array<string>, keywords array<string>, examples array<string>, required_slots array<string>, enabled boolean, version string, created_at timestamp, deleted_at timestamp, recommendation_case_id string, recommendations array<struct<label:string,intent:string>>, slot_policy map<string,double>, intents array<struct<{', '.join(f'{c.split()[0]}:{c.split(None, 1)[1]}' for c in _top_level(INTENT))}>>"


@dataclass
class App:
    """A compiled configuration."""

    scenes: DataFrame
    templates: DataFrame
    seeds: DataFrame
    cases: DataFrame
    policies: DataFrame
    documents: dict


def compile_app(spark: SparkSession, config: dict) -> App:
    """The dimension tables of a configuration (capabilities, and small documents); a broken constraint raises ValueError."""
    listed, defaults = capability_list(config["capabilities"])
    lines = spark.createDataFrame([(json.dumps(c, ensure_ascii=False),) for c in listed], "j string")
    capabilities = lines.select(F.from_json("j", CAPABILITY).alias("c")).select("c.*")
    intents = capabilities.where(F.coalesce(F.col("enabled"), F.lit(True))).select("capability_id", F.inline("intents")).withColumn("intent_id", F.concat_ws("/", "capability_id", "case_id"))
    policy = spark.createDataFrame([(defaults,)], "slot_policy map<string,double>") if defaults else None
    documents = {k: v for k, v in config.items() if k != "capabilities"}
    require_none(all_violations(violations("capability_unique", capabilities, F.col("capability_id"), unique=True), violations("intent_unique", intents, F.col("intent_id"), unique=True)))
    return App(scenes(capabilities), templates(intents), seeds(intents), cases(capabilities), slot_policies(capabilities, policy), documents)


def load_app(spark: SparkSession, folder: str, names: tuple[str, ...] = ("capabilities", "rules", "thresholds", "vector")) -> App:
    """Reads a folder of configuration files and compiles them."""
    return compile_app(spark, load_config(folder, names))

"""Options that a request is offered: templates and actions, its own scene's first, by reason, once each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.operators.ranking import top_k

OPTION = "struct<label:string,intent:string,slot_value:string>"
_NONE = f"array<{OPTION}>"
_PLACED = f"array<struct<ord:bigint,scene_id:string,o:{OPTION}>>"


def option(label: Column | str, intent: Column | str | None, slot_value: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(label).cast("string").alias("label"), lit(intent).cast("string").alias("intent"), lit(slot_value).cast("string").alias("slot_value"))


def _clean(items: DataFrame, blocked: list[str]) -> DataFrame:
    label = F.trim(F.coalesce("label", F.lit("")))
    ok = reduce(lambda a, w: a & ~F.contains(F.lower(label), F.lit(w.lower())), blocked, label != "")
    return items.withColumn("label", label).where(ok)


def scene_first(requests: DataFrame, scene: str, items: DataFrame, limit: int, name: str, blocked: list[str] = ()) -> DataFrame:
    """requests with `name`: the first `limit` items (scene_id, ord, label, intent), those of the request's scene first, then
    by ord; blank labels and such with a blocked word are left out.

    Of each scene only its first items matter, and of all together the first 2 * limit: these are joined,
    not the items themselves.
    """
    items = _clean(items, list(blocked))
    packed = F.array_sort(F.collect_list(F.struct("ord", "scene_id", option(F.col("label"), F.col("intent")).alias("o"))))  # at most limit or 2 * limit
    own = top_k(items.where("scene_id is not null"), ["scene_id"], [F.col("ord")], limit).groupBy("scene_id").agg(packed.alias("_own"))
    anywhere = items.orderBy("ord").limit(2 * limit).agg(packed.alias("_any"))
    out = requests.join(own.withColumnRenamed("scene_id", "_scene"), F.col(scene) == F.col("_scene"), "left").crossJoin(F.broadcast(anywhere))
    none = F.array().cast(_PLACED)
    rest = F.filter("_any", lambda x: ~F.coalesce(x["scene_id"] == F.col(scene), F.lit(False)))
    both = F.concat(F.coalesce(F.col("_own").cast(_PLACED), none), F.coalesce(rest.cast(_PLACED), none))
    return out.withColumn(name, F.transform(F.slice(both, 1, limit), lambda x: x["o"])).drop("_own", "_any", "_scene")


def distinct_options(*parts: Column, limit: int = 4, fallback: Column | None = None) -> Column:
    """Options of the parts in order, each (label, intent, slot_value) once, cut to limit; the fallback if none is left."""
    all_ = F.slice(F.array_distinct(F.concat(*(F.coalesce(p.cast(_NONE), F.array().cast(_NONE)) for p in parts))), 1, limit)
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(fallback).cast(_NONE) if fallback is not None else F.array().cast(_NONE))


def by_reason(reason: Column, sequences: dict[str, list[Column]], default: list[Column], fallback: Column, limit: int = 4) -> Column:
    """Options for a reason: the parts listed for it, else the default parts."""
    out = distinct_options(*default, limit=limit, fallback=fallback)
    for name, parts in sequences.items():
        out = F.when(reason == name, distinct_options(*parts, limit=limit, fallback=fallback)).otherwise(out)
    return out


def from_hits(hits: Column, otherwise: Column, limit: int = 4) -> Column:
    """Hits (label, case_id, scene_id) as options, else the others."""
    mine = F.transform(F.slice(hits, 1, limit), lambda h: option(F.coalesce(h["label"], F.lit("similar")), "seed_case", h["case_id"]))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, mine.cast(_NONE)).otherwise(otherwise)


def from_scenes(scenes: Column, pattern: str, limit: int = 3) -> Column:
    """Scene ids as options; pattern holds %s for the id."""
    return F.transform(F.slice(scenes, 1, limit), lambda s: option(F.format_string(pattern, s), s)).cast(_NONE)


def for_slot(slot: Column, presets: dict[str, list[str]], candidates: Column, most: int = 3, pattern: str = "give %s") -> Column:
    """Options for a missing slot: its presets, else the first candidates (name, entity_id), else one that asks for it."""
    ask = F.array(option(F.format_string(pattern, slot), None)).cast(_NONE)
    some = F.transform(F.slice(candidates, 1, most), lambda c: option(F.coalesce(F.nullif(c["name"], F.lit("")), c["entity_id"]), None, c["entity_id"])).cast(_NONE)
    out = F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, some).otherwise(ask)
    for name, values in presets.items():
        out = F.when(slot == name, F.array(*(option(v, None, F.lit(v)) for v in values)).cast(_NONE)).otherwise(out)
    return out

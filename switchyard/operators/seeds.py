"""Batch import: typed rows with a reason if invalid, duplicates by policy, upsert, foreign keys, write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.functions.text import bool_word, clean_list, repaired_json, split_tags, uni_trim

#: Fields that must be there, and defaults of the other texts.
REQUIRED = ("case_id", "scene_id", "label", "text")
DEFAULTS = {"route_type": "route_nl2sql", "owner": "", "version": "v1", "risk_level": "medium", "source": "import", "notes": ""}


def normalized_rows(rows: DataFrame, order: str) -> DataFrame:
    """Seed rows typed and defaulted, with `reason` (null if valid). Nothing is dropped.

    A field that is null, or that rows has not, takes its default; one that is blank stays blank, which is false
    for `enabled` and invalid for `priority`. Words for `enabled` that mean neither are invalid; text needs two
    characters. `slots` (a JSON text, struct or map) goes before `slots_json`; tags are an array or one text.
    """
    kinds = dict(rows.dtypes)
    trimmed = lambda c: uni_trim(F.col(c).cast("string")) if c in kinds else F.lit(None).cast("string")
    texts = {c: trimmed(c) for c in (*REQUIRED, *DEFAULTS, "enabled", "priority", "slots_json")}
    texts["slots"] = F.to_json(F.col("slots")) if kinds.get("slots", "string") != "string" else trimmed("slots")
    texts["tags"] = clean_list(F.col("tags")) if kinds.get("tags", "").startswith("array") else split_tags(trimmed("tags"))
    # Trimmed once: a filter on the result would else be pushed down with a copy of every expression in it.
    t = rows.select(F.col(order), F.explode(F.array(F.struct(*(c.alias(name) for name, c in texts.items())))).alias("t")).select(F.col(order), "t.*")
    with_default = lambda c, value: F.coalesce(F.col(c), F.lit(value))
    reason = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        reason = F.when(with_default(c, "") == "", f"missing_{c}").otherwise(reason)
    enabled, priority = bool_word(with_default("enabled", "true")), with_default("priority", "100").try_cast("int")
    given = F.coalesce(F.nullif(F.col("slots"), F.lit("")), F.nullif(F.col("slots_json"), F.lit("")))
    slots = F.when(given.isNotNull(), repaired_json(given)).otherwise("{}")
    reason = F.coalesce(reason, F.when(F.length("text") < 2, "short_text"), F.when(enabled.isNull(), "bad_enabled"), F.when(priority.isNull(), "bad_priority"))
    typed = t.select(
        F.col(order), *(with_default(c, "").alias(c) for c in REQUIRED), slots.alias("slots_json"), "tags", enabled.alias("enabled"), priority.alias("priority"), reason.alias("reason"),
        *(with_default(c, value).alias(c) for c, value in DEFAULTS.items()),
    )
    return typed.withColumn("reason", F.coalesce("reason", F.when(F.col("slots_json").isNull(), "bad_slots")))


def one_per_key(rows: DataFrame, key: str, order: str, policy: str = "keep_last") -> DataFrame:
    """One row per key by policy, placed at the key's first position (`position`), with n_rows; one combining aggregation.

    error keeps nothing back: it returns the rows of keys that occur more than once, with position and n_rows.
    """
    first, n = F.min(order).alias("position"), F.count("*").alias("n_rows")
    if policy == "error":
        return rows.join(rows.groupBy(key).agg(first, n).where("n_rows > 1"), key)
    if policy not in ("keep_first", "keep_last"):
        raise ValueError(policy)
    rest = [c for c in rows.columns if c != key]
    if rest == [order]:
        best = (F.min if policy == "keep_first" else F.max)(order).alias(order)
        return rows.groupBy(key).agg(best, first, n)
    pick = F.min_by if policy == "keep_first" else F.max_by
    return rows.groupBy(key).agg(pick(F.struct(*rest), order).alias("r"), first, n).select(key, "r.*", "position", "n_rows")


def import_counts(rows: DataFrame, key: str, policy: str = "keep_last") -> DataFrame:
    """rows_total, rows_ok (rows that are kept), rows_invalid, duplicates, output_count of normalized rows, in one pass over
    grouped keys. Duplicates count as invalid under the policy `error`."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("reason").isNull(), 1)).alias("ok"))
    kept, more = F.least(F.col("ok"), F.lit(1)), F.greatest(F.col("ok") - 1, F.lit(0))
    invalid = F.col("n") - F.col("ok") + (more if policy == "error" else F.lit(0))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per.agg(total(F.col("n"), "rows_total"), total(kept, "rows_ok"), total(invalid, "rows_invalid"), total(more, "duplicates"), total(kept, "output_count"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of both, those of incoming winning as wholes; the column `origin` tells which."""
    columns = existing.columns
    a = existing.select(key, F.struct(*columns).alias("old"))
    b = incoming.select(key, F.struct(*columns).alias("new"))
    both = a.join(b, key, "full")
    row = F.coalesce("new", "old")
    origin = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").otherwise("replaced")
    return both.select(row.alias("r"), origin.alias("origin")).select("r.*", "origin")


def merged(existing: DataFrame, incoming: DataFrame, key: str, mode: str = "replace") -> DataFrame:
    """incoming alone, or written over existing by key, in order of the key's code points."""
    if mode not in ("replace", "upsert"):
        raise ValueError(mode)
    return (incoming if mode == "replace" else upsert(existing, incoming, key).drop("origin")).orderBy(key)


def missing_keys(rows: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose non-null key is in no parent row."""
    keys = parents.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    return rows.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def not_yet_listed(legacy: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Legacy rows whose key the newer list does not have; null keys count as not listed."""
    return legacy.join(listed.select(key).distinct(), key, "left_anti")


def carried_templates(incoming: DataFrame, intents: DataFrame) -> DataFrame:
    """incoming (scene_id, case_id, ...) with the template_id that an intent of that scene and case had before, the least of several; null if none had."""
    before = intents.where(F.trim(F.coalesce("template_id", F.lit(""))) != "").groupBy("scene_id", "case_id").agg(F.min("template_id").alias("template_id"))
    return incoming.drop("template_id").join(before, ["scene_id", "case_id"], "left")


#: Most children in one list; a key with more has several rows.
MOST_LISTED = 100_000


def grouped_back(parents: DataFrame, children: DataFrame, key: str, child: str, most: int | None = None) -> DataFrame:
    """Parents with the sorted list of their children's ids (`children`); parents without any keep an empty list.

    A key's children are counted first; beyond MOST_LISTED they come in several rows of the parent (`part`, from
    0), by hash, each sorted, so that no list grows with the data.
    """
    most = MOST_LISTED if most is None else most
    some = children.select(key, child).where(F.col(key).isNotNull() & F.col(child).isNotNull())
    parts = some.groupBy(key).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).where("parts > 1")
    parted = some.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(child), F.col("parts")), F.lit(0)).cast("int"))
    lists = parted.groupBy(key, "part").agg(F.sort_array(F.collect_list(child)).alias("children"))
    empty = F.array().cast(f"array<{dict(children.dtypes)[child]}>")
    return parents.join(lists, key, "left").withColumns({"children": F.coalesce("children", empty), "part": F.coalesce("part", F.lit(0))})

"""Gates, overrides, option lists and traces of a routing pipeline, as expressions over configuration values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.text import uni_trim
from switchyard.operators.ranking import ordered_union


def override_chain(allowed: list[str], *sources: Column) -> Column:
    """The first source whose trimmed lower-case value is allowed; else null."""
    return F.coalesce(*(F.when(F.lower(uni_trim(c)).isin(*allowed), F.lower(uni_trim(c))) for c in sources))


def label_by_words(c: Column, exact: list[str], rules: list[tuple[list[list[str]], str]], otherwise: str) -> Column:
    """A model's free answer as a label: an exact one, else the first rule of which one group of words all occur."""
    word = F.lower(uni_trim(c))
    out = F.when(word.isin(*exact), word)
    for groups, label in rules:
        hit = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for w in group:
                every = every & F.contains(word, F.lit(w))
            hit = hit | every
        out = out.when(F.coalesce(hit, F.lit(False)), label)
    return out.otherwise(otherwise)


def support_guard(applies: Column, n_hits: Column, top: Column, least_hits: int, least_score: float, reason: str) -> Column:
    """reason where the guard applies and the hits are too few or too weak; else null."""
    weak = (F.coalesce(n_hits, F.lit(0)) < least_hits) | (F.coalesce(top, F.lit(0.0)) < least_score)
    return F.when(F.coalesce(applies, F.lit(False)) & weak, reason)


def template_gate(flow: Column, template: Column, score: Column, missing: Column, threshold: float, skip: str = "report") -> Column:
    """Null to go on; clarify with the first two missing slots; or route with the template."""
    ready = (F.coalesce(flow, F.lit("")) != skip) & template.isNotNull() & (score >= threshold)
    asks = F.concat(F.lit("clarify:"), F.array_join(F.slice(missing, 1, 2), ","))
    return F.when(F.coalesce(ready, F.lit(False)), F.when(F.size(missing) > 0, asks).otherwise(F.concat(F.lit("route:"), template)))


def flow_gate(flow: Column, name: str = "report") -> Column:
    return F.when(flow == name, f"route_{name}")


def lookup_failed(error: Column, n_candidates: Column, *known: Column) -> Column:
    """Whether a failed lookup leaves nothing: an error, no candidate and none of the known values."""
    nothing = F.lit(True)
    for c in known:
        nothing = nothing & (F.coalesce(uni_trim(c.cast("string")), F.lit("")) == "")
    return error.isNotNull() & (F.coalesce(n_candidates, F.lit(0)) == 0) & nothing


def reason_options(reason: Column, sequences: dict[str, list[Column]], default: list[Column], limit: int = 4, fallback: str = "capability.list") -> Column:
    """Options by reason: arrays in order, each option once, cut to limit; the fallback if none is left."""
    out = None
    for name, parts in sequences.items():
        options = ordered_union(limit, *parts)
        out = F.when(reason == name, options) if out is None else out.when(reason == name, options)
    options = out.otherwise(ordered_union(limit, *default)) if out is not None else ordered_union(limit, *default)
    return F.when(F.size(options) > 0, options).otherwise(F.array(F.lit(fallback)))


def candidate_options(candidates: Column, most: int = 3) -> Column:
    """Labels of the first candidates, an array of structs (name, entity_id), by name or id."""
    return F.transform(F.slice(candidates, 1, most), lambda c: F.coalesce(F.nullif(c["name"], F.lit("")), c["entity_id"]))


def trace(*steps: tuple[str, Column, Column | None]) -> Column:
    """Steps of a request up to the first that decides: (name, decision or null, score)."""
    out, open_ = [], F.lit(True)
    for name, decision, score in steps:
        row = F.struct(F.lit(name).alias("step"), F.coalesce(decision, F.lit("continue")).alias("decision"), (F.lit(None) if score is None else score).cast("double").alias("score"))
        out.append(F.when(open_, row))
        open_ = open_ & decision.isNull()
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def rendered_trace(steps: Column, level: str = "compact") -> Column:
    """compact: step and decision; debug: the score as well; as text in order."""
    if level == "debug":
        return F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["step"], s["decision"], F.format_number(s["score"], 3))), ">")
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["step"], s["decision"])), ">")


def case_weight(kind: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(w)) for k, w in weights.items()), F.lit(default))


def benchmark_row(cases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id and `row`, the case as JSON for an evaluation set: expected without nulls, its weight by type, and role, tenant and
    context only where they say something."""
    said = lambda c: F.when(F.coalesce(uni_trim(F.col(c)), F.lit("")) != "", F.col(c))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    row = F.struct("id", "text", "expected", tags.alias("tags"), case_weight(F.col("expected.type"), weights).alias("weight"), said("role").alias("role"), said("tenant_id").alias("tenant_id"), "context")
    return cases.select("id", F.to_json(row).alias("row"))

"""Dictionary matches by domain: which domains a request is matched in, and one answer per slot out of several domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.operators.dictionary import find_terms, first_matches, penalised, with_terms
from switchyard.operators.ranking import commit, ordered_union, top_k

_NONE = "array<string>"
#: Slots whose candidates are published.
PUBLISHED = ("device_id", "region_id")


def _priority(domain: Column, priorities: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*(F.when(domain == d, F.lit(p)) for d, p in priorities.items()), F.lit(otherwise))


def available_domains(terms: DataFrame, priorities: dict[str, float]) -> list[str]:
    """Domains that have terms, by falling priority, then name. There are as many as configurations name, so they fit a list."""
    names = [r.domain for r in terms.select("domain").where("domain is not null").distinct().collect()]
    return sorted(names, key=lambda d: (-priorities.get(d, 0.0), d))


def _listed(key: Column, lists: dict[str, list[str]]) -> Column:
    out = F.array().cast(_NONE)
    for name, domains in lists.items():
        out = F.when(key == name, F.array(*map(F.lit, domains))).otherwise(out)
    return F.coalesce(out, F.array().cast(_NONE))


def select_domains(text: Column, available: list[str], scenes: list[Column], slots: Column, scene_domains: dict[str, list[str]], slot_domains: dict[str, list[str]], keyword_domains: dict[str, list[str]], defaults: list[str], most: int = 2, enabled: bool = True) -> Column:
    """The domains of a request: those of its scenes, of the slots it holds (an array of names), of words in it; else the
    defaults; else all available. Each once, in this order, of the available ones alone, cut to `most`."""
    names = lambda x: F.array(*map(F.lit, x)).cast(_NONE) if x else F.array().cast(_NONE)
    if not enabled:
        return F.slice(names(available), 1, most)
    low = F.lower(text)
    by_word = []
    for domain, words in keyword_domains.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        by_word.append(F.when(F.coalesce(hit, F.lit(False)), names([domain])).otherwise(names([])))
    by_slot = F.flatten(F.transform(F.coalesce(slots, names([])), lambda s: _listed(s, slot_domains)))
    there = lambda c: F.array_intersect(c, names(available))
    asked = there(ordered_union(1 << 20, *(_listed(s, scene_domains) for s in scenes), by_slot, *by_word))
    rest = F.when(F.size(there(names(defaults))) > 0, there(names(defaults))).otherwise(names(available))
    return F.slice(F.when(F.size(asked) > 0, asked).otherwise(rest), 1, most)


def matches_by_domain(requests: DataFrame, request: str, text: str, selected: str, found: DataFrame | None) -> DataFrame | None:
    """Matches of the terms of each request's selected domains (an array column). Without a dictionary there is no stage: None."""
    if found is None:
        return None
    hits = find_terms(requests, request, text, found)
    return hits.join(requests.select(request, selected), request).where(F.array_contains(selected, F.col("domain"))).drop(selected)


def best_by_domain(requests: DataFrame, request: str, text: str, selected: str, found: DataFrame, slot_domains: dict[str, list[str]], k: int, penalty: float = 0.2) -> DataFrame:
    """Of matches_by_domain, those that can be among the first k of each slot when they are arbitrated; the others are not put together."""
    places, terms = first_matches(requests, request, text, found, ["slot", "domain"], F.coalesce("value", "entity_id", "folded"), [_net(slot_domains, penalty).desc(), F.col("entity_id")], k)
    return with_terms(places, request, terms, requests.select(request, selected)).where(F.array_contains(selected, F.col("domain"))).drop(selected)


def _net(slot_domains: dict[str, list[str]], penalty: float) -> Column:
    return F.round(penalised(F.col("score"), F.coalesce("domain", F.lit("")), _listed(F.col("slot"), slot_domains), penalty), 9)


def arbitrated(matches: DataFrame, request: str, priorities: dict[str, float], slot_domains: dict[str, list[str]], penalty: float = 0.2) -> DataFrame:
    """The best match of each slot and value over all domains, with `value_`, `rank` within its slot: by score less the penalty
    for a domain that the slot does not list, then domain priority, length, place."""
    each = matches.withColumns({
        "value_": F.coalesce("value", "entity_id", "folded"),
        "net": _net(slot_domains, penalty),
        "priority": _priority(F.col("domain"), priorities, 0.0),
        "size": F.col("last") - F.col("first") + 1,
    })
    order = [F.col("net").desc(), F.col("priority").desc(), F.col("size").desc(), F.col("first"), F.col("domain"), F.col("folded"), F.col("entity_id")]
    best = top_k(each, [request, "slot", "value_"], order, 1, "_r").drop("_r")
    return top_k(best, [request, "slot"], [*order, F.col("value_")], 1 << 30)


def prefilled(ranked: DataFrame, request: str, held: DataFrame, least_score: float = 0.95, least_gap: float = 0.05, candidates: int = 3) -> DataFrame:
    """Per request and slot: the best value, whether it is taken (sure, ahead, and the slot not held: request, slot), and for
    PUBLISHED slots the first candidates as (entity_id, name, score)."""
    one, two = F.col("rank") == 1, F.col("rank") == 2
    some = ranked.where(F.col("rank") <= max(2, candidates))
    candidate = F.struct("rank", F.coalesce("entity_id", "value_").alias("entity_id"), F.coalesce("entity_name", "folded").alias("name"), "score")
    per = some.groupBy(request, "slot").agg(
        F.max(F.when(one, F.col("value_"))).alias("value"), F.max(F.when(one, F.col("score"))).alias("top1"), F.max(F.when(two, F.col("score"))).alias("top2"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= candidates, candidate))).alias("c"),  # at most `candidates`
    )
    out = per.join(held.select(request, "slot", F.lit(True).alias("held")), [request, "slot"], "left")
    taken = commit(F.col("top1"), F.col("top2"), least_score, least_gap) & F.col("held").isNull()
    published = F.when(F.col("slot").isin(*PUBLISHED), F.transform("c", lambda x: x.dropFields("rank")))
    return out.select(request, "slot", "value", taken.alias("committed"), published.alias("candidates"))


def merged_candidates(existing: DataFrame, more: DataFrame, by: list[str], blank_ids: bool = True) -> DataFrame:
    """One candidate (entity_id, name, score, ord) per id, of the best score, the first of equals; blank ids kept or dropped."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    if not blank_ids:
        both = both.where(F.trim(F.coalesce("entity_id", F.lit(""))) != "")
    return top_k(both, [*by, "entity_id"], [F.col("score").desc(), F.col("_from"), F.col("ord")], 1, "_r").drop("_r", "_from")

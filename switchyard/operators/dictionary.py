"""Dictionary matching: all occurrences of many terms in texts, and ranking and merging of what they say.

Terms are (term, domain, slot, value, entity_id, entity_name, score, word_boundary). All matches of a
text are found in one pass by an automaton that is built once per worker from the terms, which are
counted and sent along; more terms than MOST_TERMS are worked off in parts, one automaton each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.functions.text import clamp, first_non_blank, uni_trim
from switchyard.operators.ranking import top_k
from switchyard.session import BROADCAST_BYTES, BROADCAST_ROWS, materialize

#: Most terms of one automaton.
MOST_TERMS = 500_000
#: Places that are ranked at a time.
PART_PLACES = 10_000
TERM_FIELDS = ("term", "domain", "slot", "value", "entity_id", "entity_name")


def patterns(terms: DataFrame, least_length: int = 2) -> DataFrame:
    """Every spelling (term and aliases, trimmed, at least least_length long) with its term's fields, best per key. `ord` is the
    first place of the key in the dictionary, by the column `ord` of terms if it has one, else 0."""
    place = F.col("ord").cast("bigint") if "ord" in terms.columns else F.lit(0).cast("bigint")
    spelled = F.concat(F.array("term"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    each = terms.select(F.explode(F.array_distinct(F.transform(spelled, uni_trim))).alias("pattern"), *TERM_FIELDS, clamp(F.col("score")).alias("score"), "word_boundary", place.alias("ord"))
    each = each.where(F.length("pattern") >= least_length).withColumn("folded", F.lower("pattern"))
    key = ["folded", "domain", "slot", "value", "entity_id"]
    each = each.withColumn("_first", F.min("ord").over(W.partitionBy(*key)))
    best = top_k(each, key, [F.col("score").desc(), F.col("pattern"), F.col("term"), F.col("entity_name")], 1, "_r")
    return best.withColumn("ord", F.col("_first")).drop("_r", "_first", "pattern")


def _is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def find_terms(texts: DataFrame, text_id: str, text: str, found: DataFrame, most: int | None = None) -> DataFrame:
    """text_id, first, last (1-based code points, last inclusive) and the fields of every matching pattern.

    Letter case is ignored; overlapping matches are all kept. A match within ASCII word characters is
    dropped if its term asks for word boundaries, or says nothing and is ASCII itself. `most` keeps the first
    matches of a text in order of end, then longest, then place in the dictionary.
    """
    full = _all_passes(texts, text_id, text, found).join(found, "folded")
    full = full.where(~(_strict() & F.col("inside"))).drop("inside")
    if most is not None:
        full = top_k(full, ["text_id"], [F.col("last"), F.col("first"), F.col("ord"), F.col("folded"), F.col("domain"), F.col("slot"), F.col("value"), F.col("entity_id")], most, "_r").drop("_r")
    return full.withColumnRenamed("text_id", text_id)


def _strict() -> Column:
    """Whether a term's match within a word is dropped."""
    return F.coalesce(F.col("word_boundary"), ~F.col("folded").rlike(r"[^\x00-\x7f]"))


def _all_passes(texts: DataFrame, text_id: str, text: str, found: DataFrame, once: bool = False) -> DataFrame:
    rows = found.select("folded").distinct()
    n_parts = max(1, -(-rows.count() // MOST_TERMS))
    hits = None
    for part in range(n_parts):
        some = [r.folded for r in rows.where(F.pmod(F.xxhash64("folded"), F.lit(n_parts)) == part).toLocalIterator()]
        got = _automaton_pass(texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")), some, once)
        hits = got if hits is None else hits.unionByName(got)
    return hits


def first_matches(texts: DataFrame, text_id: str, text: str, found: DataFrame, by: list[str], value: Column, order: list[Column], k: int) -> tuple[DataFrame, DataFrame]:
    """Of find_terms, what can be among the k best values of a text: places (text_id, folded, terms, first, last) and terms
    (folded, terms and the fields), to be joined by `with_terms`.

    For rankings within `by` (fields of the terms) that look at `order` (of fields), the length, the first place and the value. A
    spelling that many terms share gives a text the same order of these terms, so that only its k best values can be among those
    of the text; and only its first place counts. That is one place of all its terms, or, if the first is within a word, this
    for the loose terms and the first outside for the strict ones.
    """
    found = found.persist(StorageLevel.DISK_ONLY)
    places = materialize(_all_passes(texts, text_id, text, found, once=True))
    each = found.join(places.select("folded").distinct(), "folded", "left_semi").withColumn("_v", value)
    each = each.withColumn("terms", F.explode(F.array(F.lit("all"), F.when(_strict(), "strict").otherwise("loose"))))
    one = top_k(each, ["folded", "terms", *by, "_v"], order, 1, "_r")
    few = materialize(top_k(one.drop("_r"), ["folded", "terms", *by], [*order, F.col("_v")], k, "_r").drop("_r", "_v", "ord", "word_boundary"))
    found.unpersist()
    return places.withColumnRenamed("text_id", text_id), few


def with_terms(places: DataFrame, text_id: str, terms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Places with the terms of their spelling, and with what `texts` says of their text. Terms that are few, as counted, are sent, so that only places move, and these by text."""
    # A number, as the parts must not be put together by the size of places: each gets many terms.
    parts = max(places.sparkSession.sparkContext.defaultParallelism, -(-places.count() // PART_PLACES))
    if texts is not None:
        places = places.join(texts, text_id)
    strings = [c for c, t in terms.dtypes if t == "string"]
    n = terms.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", *strings))), F.lit(0)).alias("bytes")).first()
    if n.rows <= BROADCAST_ROWS and n.bytes <= BROADCAST_BYTES:
        return places.repartition(parts, text_id).join(F.broadcast(terms), ["folded", "terms"]).drop("terms")
    return places.join(terms, ["folded", "terms"]).drop("terms").repartition(parts, text_id)


#: The automaton that a worker built last, by name.
_BUILT: dict[str, object] = {}


def _automaton(name: str, patterns_: list[str]):
    if name not in _BUILT:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in patterns_:
            machine.add_word(p, p)
        if len(machine):
            machine.make_automaton()
        _BUILT.clear()
        _BUILT[name] = machine
    return _BUILT[name]


def _first_places(hits: list[tuple]) -> Iterator[tuple]:
    """Of the hits of one text, the first of each pattern, and the first outside of words if that is another, with the terms that they count for."""
    at: dict[str, tuple] = {}
    free: dict[str, tuple] = {}
    for hit in hits:  # by the end, so for one pattern by its place
        at.setdefault(hit[1], hit)
        if not hit[4]:
            free.setdefault(hit[1], hit)
    for p, hit in at.items():
        yield *hit[:4], "loose" if hit[4] else "all"
        if hit[4] and p in free:
            yield *free[p][:4], "strict"


def _automaton_pass(texts: DataFrame, some: list[str], once: bool = False) -> DataFrame:
    """Every hit, and whether it is inside a word; with once, only first places (see first_matches)."""
    sent, name = texts.sparkSession.sparkContext.broadcast(some), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _automaton(name, sent.value)
        for batch in batches:
            out = []
            for key, t in zip(batch["text_id"], batch["text"]):
                if not t or not len(machine):
                    continue
                # Folding character by character keeps places where lower case is longer.
                low = t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                hits = []
                for end, p in machine.iter(low):
                    begin = end - len(p) + 1
                    inside = begin > 0 and _is_word(t[begin - 1]) or end + 1 < len(t) and _is_word(t[end + 1])
                    hits.append((key, p, begin + 1, end + 1, bool(inside)))
                out += _first_places(hits) if once else hits
            yield pd.DataFrame(out, columns=["text_id", "folded", "first", "last", last])

    kind, last = dict(texts.dtypes)["text_id"], "terms" if once else "inside"
    return texts.mapInPandas(run, f"text_id {kind}, folded string, first int, last int, {last} {'string' if once else 'boolean'}")


def _value() -> Column:
    return F.coalesce(F.col("value"), F.col("entity_id"), F.col("folded"))


def _rank(priorities: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col("domain") == d, F.lit(p)) for d, p in priorities.items()), F.lit(0.5))  # one rank for all without priorities


def best_values(texts: DataFrame, text_id: str, text: str, found: DataFrame, priorities: dict[str, float], k: int = 3) -> DataFrame:
    """ranked_values of all matches, without putting together those that cannot be among the best."""
    order = [F.col("score").desc(), _rank(priorities).desc(), F.col("domain")]
    places, terms = first_matches(texts, text_id, text, found, ["slot"], _value(), order, k)
    return ranked_values(with_terms(places, text_id, terms), text_id, priorities, k)


def ranked_values(matches: DataFrame, text_id: str, priorities: dict[str, float], k: int = 3) -> DataFrame:
    """Best match per slot and value, then the k best values per slot: score, domain priority, length, place."""
    each = matches.withColumn("slot_value", _value()).withColumn("priority", _rank(priorities)).withColumn("size", F.col("last") - F.col("first") + 1)
    order = [F.col("score").desc(), F.col("priority").desc(), F.col("size").desc(), F.col("first"), F.col("domain"), F.col("folded")]
    best = top_k(each, [text_id, "slot", "slot_value"], order, 1, "_r").drop("_r")
    return top_k(best, [text_id, "slot"], [*order, F.col("slot_value")], k)


def penalised(score: Column, domain: Column, allowed: Column, penalty: float = 0.2) -> Column:
    """score, less the penalty if the slot lists domains and this is not one of them."""
    return score - F.when(allowed.isNull() | (F.size(allowed) == 0) | F.array_contains(allowed, domain), 0.0).otherwise(penalty)


def merged_terms(terms: DataFrame, least_length: int = 1, order: str | None = None) -> DataFrame:
    """One row per key (domain, slot, value, entity, term; all in any case): the fields of its first row, the best score, the
    largest metadata (a map column, if there is one), the first word boundary that is said, all aliases once in any case in their first
    spelling and without the term itself. Terms that are too short and such without a slot are left out.

    First is by the column `order`, by default `ord`, or else the fields themselves. Aliases are compared one
    by one, so that no list of a hot key has to be put together before they are distinct.
    """
    fields = ("term", "domain", "slot", "value", "entity_id")
    clean = {c: uni_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (*fields, "entity_name")}
    key = F.md5(F.lower(F.concat_ws("|", *(clean[c] for c in ("domain", "slot", "value", "entity_id", "term")))))
    by = order or ("ord" if "ord" in terms.columns else None)
    first = F.struct(*([F.col(by)] if by else []), *(clean[c] for c in (*fields, "entity_name")))
    some = terms.where((F.length(clean["term"]) >= least_length) & (clean["slot"] != "")).withColumn("key", key).withColumn("_first", first)
    kept = lambda c: F.nullif(F.min_by(clean[c], "_first"), F.lit("")) if c not in ("term", "slot") else F.min_by(clean[c], "_first")
    score = clamp(F.coalesce(F.col("score"), F.lit(0.99)))
    extra = [F.max_by("metadata", F.struct(F.size("metadata"), F.hash(F.to_json("metadata")))).alias("metadata")] if "metadata" in terms.columns else []
    heads = some.groupBy("key").agg(
        *(kept(c).alias(c) for c in (*fields, "entity_name")), F.max(score).alias("score"), F.min_by("word_boundary", F.when(F.col("word_boundary").isNotNull(), F.col("_first"))).alias("word_boundary"), F.count("*").alias("n_rows"), *extra
    )
    spelled = some.select("key", "_first", F.posexplode("aliases").alias("place", "alias")).withColumn("alias", uni_trim(F.col("alias"))).where("alias <> ''")
    once = spelled.groupBy("key", F.lower("alias").alias("folded")).agg(F.min_by("alias", F.struct("_first", "place", "alias")).alias("alias"), F.min(F.struct("_first", "place", "alias")).alias("at"))
    lists = once.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    out = heads.join(lists, "key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("key")
    return out.withColumn("aliases", F.filter("aliases", lambda x: x != F.col("term")))


def in_order(merged: DataFrame) -> DataFrame:
    """Merged terms by domain, slot and term, for an export."""
    return merged.orderBy(F.coalesce("domain", F.lit("")), "slot", "term")


def asset_terms(assets: DataFrame, domain: str, slot: str, ids: list[str], names: list[str], ip: str | None = None) -> DataFrame:
    """Term rows of asset records: entity by the first non-blank id and name field, and one more row for a valid IPv4 address."""
    from switchyard.functions.text import is_ipv4

    entity, name = first_non_blank(*(F.col(c).cast("string") for c in ids)), first_non_blank(*(F.col(c).cast("string") for c in names))
    rows = [F.struct(name.alias("term"), F.lit(0.99).alias("score"))]
    if ip:
        rows.append(F.struct(F.when(is_ipv4(uni_trim(F.col(ip))), uni_trim(F.col(ip))).alias("term"), F.lit(0.995).alias("score")))
    each = assets.select(entity.alias("entity_id"), name.alias("entity_name"), F.inline(F.array(*rows))).where("term is not null and entity_id is not null")
    return each.select("term", F.lit(domain).alias("domain"), F.lit(slot).alias("slot"), F.col("entity_id").alias("value"), "entity_id", "entity_name", "score")


def n_domains(matches: DataFrame, text_id: str) -> DataFrame:
    """Matches of each text per domain."""
    return matches.groupBy(text_id, "domain").agg(F.count("*").alias("n_matches"))

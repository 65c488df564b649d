"""Queries of details: policies, contexts, vectors, cut matches, answers of models, loaded configurations, traces."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import extract, scoring, text
from switchyard.operators import dictionary, ranking, retrieve, routing, slots
from switchyard.plans import compiler
from switchyard.plans.data_catalogue import _H5, _hits
from switchyard.plans.registry import Register
from switchyard.plans.request_catalogue import _SC, _case_sql, scenes
from switchyard.plans.text_catalogue import _GAPS, _SPELL, GOLDEN, scope_gaps
from switchyard.session import shared_folder, table
from switchyard.sources.services import needs_model

register = Register()

# ---------------------------------------------------------------- slots and contexts

_DEFAULTS = [(None, "*", 0.5, 0.5), (None, "time_range", 0.9, 0.1), (None, "metric", 0.8, None), (None, "device_id", 0.75, 0.45)]
_DEFAULT_SQL = "(VALUES " + ", ".join(f"('{s}', {p}, {'NULL' if c is None else c})" for _, s, p, c in _DEFAULTS) + ") d(slot, priority, cost)"


@register(f"""WITH {_SC}, p AS (SELECT scene_id, unnest(required) AS slot FROM sc), own AS (SELECT capability_id AS scene_id, 'metric' AS slot, max(router_priority) / 100.0e0 AS priority FROM capabilities WHERE router_priority > 80 GROUP BY 1)
  SELECT p.scene_id, p.slot, CAST(coalesce(own.priority, d.priority, 0.5) AS DOUBLE) AS priority, CAST(coalesce(d.cost, 0.5) AS DOUBLE) AS cost FROM p LEFT JOIN own ON own.scene_id = p.scene_id AND own.slot = p.slot LEFT JOIN {_DEFAULT_SQL} ON d.slot = p.slot""")
def slot_policy_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority and cost of every required slot of every scene: the scene's own, the slot's, or those of any."""
    asked = scenes(spark, sf_dir).select("scene_id", F.explode("required_slots").alias("slot"))
    own = table(spark, sf_dir, "capabilities").where("router_priority > 80").groupBy(F.col("capability_id").alias("scene_id")).agg((F.max("router_priority") / 100.0).alias("priority"))
    policies = spark.createDataFrame(_DEFAULTS, "scene_id string, slot string, priority double, cost double").unionByName(own.select("scene_id", F.lit("metric").alias("slot"), "priority", F.lit(None).cast("double").alias("cost")))
    return slots.with_policies(asked, policies, ["priority", "cost"]).select("scene_id", "slot", "priority", "cost")


@register(f"""SELECT id, ({_case_sql('lower(text)', extract.METRICS)}) IS NOT NULL OR ({_case_sql('text', extract.REGIONS)}) IS NOT NULL AS signal FROM {GOLDEN}""")
def infer_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request names a metric or a region."""
    entities = extract.extract_entities(F.col("text"), "UTC")
    return table(spark, sf_dir, GOLDEN).select("id", slots.has_signal(entities, F.array(F.lit("metric"), F.lit("region_hint"))).alias("signal"))


@register(f"""WITH g AS (SELECT id, context.scene AS scene, TRY_CAST(context.clarify_round AS INTEGER) AS n, CAST(right(id, 1) AS INTEGER) % 4 AS k FROM {GOLDEN})
  SELECT id, CASE WHEN k < 3 THEN scene END AS scene, CASE WHEN k = 0 THEN 'a=x' ELSE '' END AS slots, CAST(CASE WHEN k = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_pending, CAST(CASE WHEN k < 3 THEN greatest(0, coalesce(n, 0)) ELSE 0 END AS BIGINT) AS round, CAST(CASE WHEN k = 1 THEN 1 ELSE 2 END AS BIGINT) AS most FROM g""")
def context_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of good and bad shapes: whole, with wrong kinds, with counters as texts, and no JSON at all."""
    k = F.substring("id", -1, 1).cast("int") % 4
    base = F.struct(F.col("context.scene").alias("scene"), F.col("context.clarify_round").alias("clarify_round"))
    whole = F.to_json(F.struct(base["scene"].alias("scene"), base["clarify_round"].alias("clarify_round"), F.create_map(F.lit("a"), F.lit("x")).alias("slots"), F.array(F.lit("p"), F.lit("q")).alias("pending_slots"), F.lit("2").alias("max_clarify_round")))
    wrong = F.to_json(F.struct(base["scene"].alias("scene"), base["clarify_round"].alias("clarify_round"), F.lit("text").alias("slots"), F.create_map(F.lit("a"), F.lit(1)).alias("pending_slots"), F.lit(-3).alias("max_clarify_round"), F.array(F.lit(1)).alias("flow_type")))
    shape = F.when(k == 0, whole).when(k == 1, wrong).when(k == 2, F.to_json(base)).otherwise("{no json")
    c = slots.coerced_context(shape)
    got = table(spark, sf_dir, GOLDEN).select("id", c.alias("c"))
    return got.select("id", "c.scene", slots.sorted_text(F.col("c.slots")).alias("slots"), F.size("c.pending_slots").cast("bigint").alias("n_pending"), F.col("c.clarify_round").cast("bigint").alias("round"), F.col("c.max_clarify_round").cast("bigint").alias("most"))


# ---------------------------------------------------------------- dictionary and retrieval


@register(f"{_SPELL.replace('SELECT *, unnest(list_distinct', 'SELECT *, CAST(right(term_id, 9) AS BIGINT) AS ord, unnest(list_distinct').replace('word_boundary, pattern, term FROM s', 'word_boundary, pattern, term, ord FROM s').replace('row_number() OVER (PARTITION BY folded, domain, slot, value, entity_id ORDER BY', 'min(ord) OVER (PARTITION BY folded, domain, slot, value, entity_id) AS first_ord, row_number() OVER (PARTITION BY folded, domain, slot, value, entity_id ORDER BY')} SELECT id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, folded, slot, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last, first, first_ord, folded, domain NULLS FIRST, slot NULLS FIRST, value NULLS FIRST, entity_id NULLS FIRST) AS nth FROM m) WHERE nth <= 2")
def dictionary_first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two matches of each text: by end, then longest, then place in the dictionary."""
    terms = table(spark, sf_dir, "ac_terms").withColumn("ord", F.substring("term_id", -9, 9).cast("bigint"))
    found = dictionary.find_terms(table(spark, sf_dir, GOLDEN).where("text is not null"), "id", "text", dictionary.patterns(terms), most=2)
    return found.select("id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "folded", "slot", "entity_id")


@register("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(CAST(a.embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS first FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with the next vector and the first part of the unit vector, by expressions alone."""
    v = table(spark, sf_dir, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"), F.round(scoring.l2_normalise(F.col("embedding"))[0], 6).alias("first"))


@register(f"WITH {_H5}, t AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, coalesce(max(score) FILTER (rank = 2), 0) AS b FROM h GROUP BY 1) SELECT query_id, a > 0 AND CASE WHEN a < 0.3 THEN true ELSE a - b < 0.08 END AS ask FROM t")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers are unsure enough to ask a model."""
    best = ranking.top_gap(_hits(spark, sf_dir, 5), ["query_id"], "item_id", "score", "item_id")
    return best.select("query_id", needs_model(F.col("top1_score"), F.col("top2_score"), True, 0.3, 0.08, True).alias("ask"))


@register(f"""WITH {_SC}, g AS (SELECT id, lower(text) AS norm, list_distinct(list_filter(string_split_regex(lower(text), '{text.TOKEN_SPLIT}'), lambda x: x <> '')) AS tokens FROM {GOLDEN} WHERE text IS NOT NULL),
  s AS (SELECT id, scene_id, CASE WHEN len(tokens) > 0 AND len(keywords) > 0 THEN len(list_filter(keywords, lambda k: list_contains(tokens, lower(k)) OR contains(norm, k))) * 1.0e0 / len(keywords) ELSE 0.0e0 END AS score FROM g CROSS JOIN sc)
  SELECT id, scene_id, round(score, 6) AS score, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, scene_id) AS rn FROM s) WHERE rn <= 3""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical retriever over the scenes' keywords; the test tables have no examples."""
    asked = table(spark, sf_dir, GOLDEN).where("text is not null").select("id", F.lower("text").alias("norm"))
    items = scenes(spark, sf_dir).select("scene_id", "keywords", F.array().cast("array<string>").alias("examples"))
    return retrieve.lexical(asked, items, 3, "id", "norm", "scene_id", "keywords", "examples").select("id", "scene_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(f"SELECT id, '' AS item, 0.0e0 AS score FROM {GOLDEN} WHERE false")
def empty_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No index, no hits."""
    return retrieve.no_hits(table(spark, sf_dir, GOLDEN), "id", "item").select("id", "item", "score")


_REGION_WORDS = {"片区": ("region_p", "P"), "机房": ("region_j", "J"), "基站": ("region_s", "S")}


@register(f"""WITH d AS (SELECT doc_id, nullif(regexp_extract(text, '(^|[^0-9])(([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})([^0-9]|$)', 2), '') AS ip, text FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, coalesce('dev_' || replace(ip, '.', '_'), '') AS device, concat_ws(',', {", ".join(f"CASE WHEN contains(text, '{w}') THEN '{e}' END" for w, (e, _) in _REGION_WORDS.items())}) AS regions FROM d""")
def resolver_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices by address and regions by word, without an index."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["entity_id"]), ",")
    return d.select("doc_id", names(retrieve.resolve_devices(F.col("text"))).alias("device"), names(retrieve.resolve_regions(F.col("text"), _REGION_WORDS)).alias("regions"))


_BOOSTS = {"term": 3.0, "entity_name": 1.0, "aliases": 2.0}
_FIELD_TEXT = {"term": "term", "entity_name": "entity_name", "aliases": "nullif(array_to_string(aliases, ' '), '')"}


def _field_sql(name: str, boost: float) -> str:
    """BM25 of one field of the dictionary, times its boost, for the terms whose number is divisible by 100."""
    split = lambda c: f"list_filter(string_split_regex(lower({c}), '{text.TOKEN_SPLIT}'), lambda x: x <> '')"
    return f"""{name}_w AS (SELECT term_id, {split(_FIELD_TEXT[name])} AS w FROM ac_terms WHERE {_FIELD_TEXT[name]} IS NOT NULL), {name}_e AS (SELECT term_id, len(w) AS dl, unnest(w) AS token FROM {name}_w),
  {name}_ix AS (SELECT term_id, token, count(*) AS tf, any_value(dl) AS dl FROM {name}_e GROUP BY 1, 2), {name}_st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w), {name}_df AS (SELECT token, count(*) AS df FROM {name}_ix GROUP BY 1),
  {name}_sc AS (SELECT query_id, ix.term_id, {boost}e0 * sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM q JOIN {name}_df USING (token) JOIN {name}_ix ix USING (token) CROSS JOIN {name}_st GROUP BY 1, 2)"""


@register(f"""WITH q AS (SELECT DISTINCT term_id AS query_id, unnest(list_filter(string_split_regex(lower(term), '{text.TOKEN_SPLIT}'), lambda x: x <> '')) AS token FROM ac_terms WHERE CAST(right(term_id, 9) AS BIGINT) % 100 = 0),
  {", ".join(_field_sql(n, b) for n, b in _BOOSTS.items())},
  b AS (SELECT query_id, term_id, max(score) AS score FROM ({" UNION ALL ".join(f"SELECT * FROM {n}_sc" for n in _BOOSTS)}) GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, term_id) AS rn FROM b)
  SELECT query_id, term_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score, CAST(rn AS BIGINT) AS rank FROM k WHERE rn <= 3""")
def resolver_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a search over boosted fields of the dictionary, scores divided by the best; terms whose number is divisible by 100 ask."""
    terms = table(spark, sf_dir, "ac_terms")
    asked = terms.where(F.substring("term_id", -9, 9).cast("bigint") % 100 == 0)
    hits = retrieve.bm25_fields(asked, terms, "term_id", "term", "term_id", _BOOSTS, 3)
    best = ranking.max_normalise(hits, ["query_id"], "score", "s")
    return best.select("query_id", F.col("doc_id").alias("term_id"), F.round("s", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(f"""{_SPELL}, v AS (SELECT *, coalesce(value, entity_id, folded) AS v FROM m WHERE domain = 'device'),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, slot, v ORDER BY score DESC, (last - first + 1) DESC, first, folded) AS r1 FROM v) WHERE r1 = 1)
  SELECT id, slot, v AS slot_value, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, slot ORDER BY score DESC, (last - first + 1) DESC, first, folded, v) AS rk FROM b) WHERE rk <= 2""")
def prefill_single_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of one domain alone: by score, length, place."""
    terms = dictionary.patterns(table(spark, sf_dir, "ac_terms")).where("domain = 'device'")
    found = dictionary.find_terms(table(spark, sf_dir, GOLDEN).where("text is not null"), "id", "text", terms)
    return dictionary.ranked_values(found, "id", {}, 2).select("id", "slot", "slot_value", F.col("rank").cast("bigint").alias("rank"))


# ---------------------------------------------------------------- answers, traces, labels


@register("""SELECT row_id, CASE row_id % 4 WHEN 0 THEN json_extract_string(slots_json, '$.object_scope') WHEN 1 THEN json_extract_string(slots_json, '$.object_scope') WHEN 2 THEN json_extract_string(slots_json, '$.object_scope') END AS scope FROM seed_cases_template WHERE json_valid(slots_json) AND json_type(slots_json) = 'OBJECT'""")
def answers_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found in answers: fenced, in a sentence, bare; and none where there is no object."""
    rows = table(spark, sf_dir, "seed_cases_template").withColumn("j", text.repaired_json(F.col("slots_json"))).where("j is not null")
    k = F.col("row_id") % 4
    said = F.when(k == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "j", F.lit(" - done"))).when(k == 2, F.col("j")).otherwise("nothing to say")
    return rows.select("row_id", F.get_json_object(text.embedded_json(said), "$.object_scope").alias("scope"))


@register(f"{_GAPS} SELECT doc_id, 'scope:' || decision || ':' || printf('%.3f', s1) || '>pick:' || top1 || ':' || printf('%.3f', s1 - s2) AS trace FROM gate")
def decision_trace_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with its scores."""
    g = scope_gaps(spark, sf_dir)
    steps = F.array(*(F.struct(F.lit(n).alias("step"), d.alias("decision"), s.alias("score")) for n, d, s in (("scope", F.col("decision"), F.col("top1_score")), ("pick", F.col("top1"), F.col("gap")))))
    return g.select("doc_id", routing.rendered_trace(steps, "debug").alias("trace"))


@register(f"""SELECT id, concat_ws(',', CASE WHEN context IS NOT NULL THEN 'context' END, 'expected', 'id', CASE WHEN nullif(trim(role), '') IS NOT NULL THEN 'role' END, 'tags', CASE WHEN nullif(trim(tenant_id), '') IS NOT NULL THEN 'tenant_id' END, CASE WHEN text IS NOT NULL THEN 'text' END, 'weight') AS keys,
  CASE WHEN expected.type IN ('route_template', 'route_nl2sql') THEN 1.2e0 WHEN expected.type = 'refuse' THEN 1.1e0 ELSE 1.0e0 END AS weight, coalesce(len(expected.missing_slots), 0) AS n_missing FROM {GOLDEN}""")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an evaluation set as they are written: optional fields only where they say something."""
    g = table(spark, sf_dir, GOLDEN)
    row = routing.benchmark_row(g, {"route_template": 1.2, "route_nl2sql": 1.2, "refuse": 1.1})
    keys = F.array_join(F.array_sort(F.json_object_keys("row")), ",")
    return row.select("id", keys.alias("keys"), F.get_json_object("row", "$.weight").cast("double").alias("weight"), F.coalesce(F.json_array_length(F.get_json_object("row", "$.expected.missing_slots")), F.lit(0)).cast("bigint").alias("n_missing"))


# ---------------------------------------------------------------- configuration


@register("""WITH c AS (SELECT capability_id, max(coalesce(enabled, true)) AS on_, count(*) AS n FROM capabilities WHERE capability_id IS NOT NULL GROUP BY 1)
  SELECT CAST(count(*) FILTER (on_) AS BIGINT) AS n_scenes, CAST(count(*) FILTER (on_) AS BIGINT) AS n_seeds, CAST(count(*) FILTER (on_) AS BIGINT) AS n_templates, CAST(count(*) FILTER (on_) AS BIGINT) AS n_cases, CAST(count(*) + 1 AS BIGINT) AS n_policies FROM c""")
def app_config_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration of files, made of the capability table (which is bounded), loaded, compiled and checked: a seed and a template for each scene."""
    caps = table(spark, sf_dir, "capabilities").where("capability_id is not null").groupBy("capability_id").agg(F.max(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.first("description").alias("description"))
    listed = [
        {"capability_id": r.capability_id, "enabled": r.enabled, "description": r.description, "examples": [" e1 ", ""], "recommendations": [{"label": "l", "intent": "i"}], "slot_policy": {"metric": 0.7},
         "intents": [{"case_id": "c", "label": "l", "template_id": f"t_{r.capability_id}", "template": {"keywords": ["k"], "slot_schema": {"required": ["metric"]}}}]}
        for r in caps.collect()
    ]
    folder = Path(shared_folder(spark, "config").removeprefix("file://")) / uuid.uuid4().hex
    folder.mkdir(parents=True)
    for name, body in {"capabilities": {"capabilities": listed, "slot_policy_defaults": {"*": 0.5}}, "rules": {}, "thresholds": {}, "vector": {}}.items():
        (folder / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False), "utf-8")
    app = compiler.load_app(spark, str(folder))
    parts = {"n_scenes": app.scenes, "n_seeds": app.seeds, "n_templates": app.templates.where("required_slots[0] = 'metric' and keywords[0] = 'k'"), "n_cases": app.cases.where("examples[0] = 'e1' and size(examples) = 1"), "n_policies": app.policies}
    return spark.createDataFrame([tuple(df.count() for df in parts.values())], ", ".join(f"{n} bigint" for n in parts))


QUERIES, SQL = register.queries, register.sql

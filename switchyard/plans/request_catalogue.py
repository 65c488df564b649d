"""Queries of requests against the configuration tables: entities, scenes and templates, domains, options, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import extract, scoring, text
from switchyard.operators import dictionary, domains, matching, options, ranking, routing, slots
from switchyard.plans import compiler, constraints
from switchyard.plans.registry import Register
from switchyard.plans.text_catalogue import _SPELL, GOLDEN, _case_sql, _matches, guard, norm_sql, tokens_sql, trim_sql
from switchyard.session import is_small, spread, table

register = Register()
ZONE = "Asia/Shanghai"
_G = f"WITH g AS (SELECT id, text, role, context, expected, tags, lower(text) AS low, {norm_sql('text')} AS norm FROM {GOLDEN})"

# ---------------------------------------------------------------- entities

_IP = r"nullif(regexp_extract(text, '(^|[^0-9])(([0-9]{1,3}\.){3}[0-9]{1,3})([^0-9]|$)', 2), '')"
_WORDS = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for ws, _ in extract.TIME_RANGES for w in ws) + " END"
_TOP = "try_cast(nullif(regexp_extract(translate(text, '０１２３４５６７８９', '0123456789'), '(?i)(?:top[ ]*|前)([0-9]+)', 1), '') AS BIGINT)"
_SHARE = "try_cast(nullif(regexp_extract(translate(text, '０１２３４５６７８９', '0123456789'), '(?:>|大于|超过)[ ]*([0-9]+(?:[.][0-9]+)?)[ ]*%', 1), '') AS DOUBLE)"
_RULES_SQL = ", ".join(f"{_case_sql('low' if lowered else 'text', rules)} AS {name}" for name, (rules, lowered) in extract.RULES.items())


@register(f"""{_G} SELECT id, {_RULES_SQL}, {_case_sql('text', extract.TIME_RANGES)} AS preset, {_WORDS} AS word, CASE WHEN {_WORDS} IS NOT NULL THEN '{ZONE}' END AS timezone,
  CAST(CASE WHEN {_TOP} BETWEEN 1 AND 1000 THEN {_TOP} END AS VARCHAR) AS topn, {_IP} AS device_ip, CASE WHEN {_SHARE} BETWEEN 0 AND 100 THEN {_SHARE} END AS threshold FROM g""")
def extract_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity of every golden request, out of the one map."""
    got = table(spark, sf_dir, GOLDEN).select("id", extract.extract_entities(F.col("text"), ZONE).alias("e"))
    at = lambda name: F.try_element_at("e", F.lit(name))
    part = lambda p: F.get_json_object(at("time_range"), f"$.{p}")
    return got.select("id", *(at(n).alias(n) for n in extract.RULES), part("preset").alias("preset"), part("original_text").alias("word"), part("timezone").alias("timezone"), at("topn").alias("topn"), at("device_ip").alias("device_ip"), at("threshold_percent").try_cast("double").alias("threshold"))


# ---------------------------------------------------------------- scenes


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spread(table(spark, sf_dir, GOLDEN).select("id", "text", "role", "context", "expected"))
    return g.withColumn("norm", text.normalize_text(F.col("text")))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled capabilities, a row per scene: its latest lifetime, in order of id (`ord`)."""
    latest = ranking.best_per_key(compiler.scenes(table(spark, sf_dir, "capabilities")).where("scene_id is not null"), ["scene_id"], [F.col("created_at").desc_nulls_last(), F.col("version").desc()])
    return latest.withColumn("ord", F.col("scene_id"))


_SC = """sc AS (SELECT * FROM (SELECT capability_id AS scene_id, coalesce(flow_type, 'query') AS flow, list_filter(list_transform(coalesce(keywords, []), lambda x: trim(x)), lambda x: x <> '') AS keywords, coalesce(entry_phrases, []) AS phrases, coalesce(required_slots, []) AS required,
    row_number() OVER (PARTITION BY capability_id ORDER BY created_at DESC NULLS LAST, version DESC) AS rn FROM capabilities WHERE coalesce(enabled, true) AND capability_id IS NOT NULL) WHERE rn = 1)"""
_SCORED = f"""{_G}, {_SC}, t AS (SELECT *, coalesce({tokens_sql('norm')}, []) AS tokens FROM g),
  p AS (SELECT id, norm, scene_id, flow, CASE WHEN len(tokens) > 0 AND len(keywords) > 0 THEN least(1.0e0, len(list_filter(keywords, lambda k: list_contains(tokens, lower(k)) OR contains(norm, k))) * 1.0e0 / len(keywords)) ELSE 0.0e0 END AS kw,
    coalesce(len(list_filter(phrases, lambda k: contains(norm, k))), 0) AS hits FROM t CROSS JOIN sc),
  s AS (SELECT id, scene_id, flow, greatest(kw, CASE WHEN hits = 0 THEN 0.0e0 ELSE least(1.0e0, 0.4e0 + 0.2e0 * hits) END) AS score FROM p)"""


def scored_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests with `s`: all scenes with their score, the greatest of keyword overlap and entry phrases, best first.

    The scenes are counted; as one array they go along with every request and are scored where it is.
    """
    dimension = scenes(spark, sf_dir)
    if not is_small(dimension, 10_000):
        raise ValueError("too many scenes for one array")
    packed = dimension.agg(F.array_sort(F.collect_list(F.struct("ord", "scene_id", "flow_type", "keywords", "entry_phrases"))).alias("_scenes"))
    r = requests(spark, sf_dir).withColumn("_tokens", text.tokenize(F.col("norm"))).crossJoin(F.broadcast(packed))

    def scored(s):
        words = scoring.keyword_overlap(F.col("norm"), F.col("_tokens"), s["keywords"])
        return F.struct((-F.coalesce(F.greatest(words, scoring.phrase_score(F.col("norm"), s["entry_phrases"])), F.lit(0.0))).alias("minus"), s["ord"].alias("ord"), s["scene_id"].alias("scene_id"), s["flow_type"].alias("flow_type"))

    return r.withColumn("s", F.explode(F.array(F.array_sort(F.transform("_scenes", scored))))).drop("_scenes", "_tokens")


@register(f"""{_SCORED}, f AS (SELECT id, flow, max(score) AS score, min(scene_id) AS o FROM s GROUP BY 1, 2)
  SELECT id, flow, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, flow) AS BIGINT) AS rank FROM f""")
def flow_scores_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score of each flow, over the scenes of the capability table."""
    each = scored_scenes(spark, sf_dir).select("id", F.inline("s"))
    per = each.groupBy("id", F.col("flow_type").alias("flow")).agg((-F.min("minus")).alias("score"))
    best = ranking.top_k(per, ["id"], [F.col("score").desc(), F.col("flow")], 9)
    return best.select("id", "flow", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register(f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, scene_id) AS rn FROM s),
  b AS (SELECT id, max(CASE WHEN rn = 1 THEN scene_id END) AS scene, max(CASE WHEN rn = 1 THEN score END) AS a, max(CASE WHEN rn = 2 THEN score END) AS b, string_agg(scene_id, ',' ORDER BY rn) FILTER (rn <= 3) AS top3 FROM r GROUP BY 1)
  SELECT id, scene, round(a, 6) AS score, CASE WHEN a < 0.52 THEN 'refuse' WHEN a - b < 0.08 THEN 'clarify' ELSE 'pass' END AS decision, top3 FROM b""")
def scope_gate_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the scenes of the capability table, with the three best for a question back."""
    s = scored_scenes(spark, sf_dir)
    one, two = -F.col("s")[0]["minus"], -F.col("s")[1]["minus"]
    return s.select("id", F.col("s")[0]["scene_id"].alias("scene"), F.round(one, 6).alias("score"), ranking.gate(one, one - two, 0.52, 0.08).alias("decision"), F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["scene_id"]), ",").alias("top3"))


@register(f"""{_G}, {_SC}, j AS (SELECT g.id, sc.scene_id, nullif(lower(trim(context.flow_type)), '') AS asked FROM g LEFT JOIN sc ON nullif(lower(trim(context.flow_type)), '') IS NULL OR lower(trim(context.flow_type)) = sc.flow)
  SELECT id, CAST(count(scene_id) AS BIGINT) AS n_scenes, max(CASE WHEN scene_id IS NULL AND asked IS NOT NULL THEN 'refuse:unsupported_domain' END) AS decision FROM j GROUP BY id""")
def scene_filter_by_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scenes a request's flow leaves, and the refusal where there is none."""
    r = requests(spark, sf_dir).select("id", F.col("context.flow_type").alias("flow_type"))
    left = matching.scenes_of_flow(r, scenes(spark, sf_dir).select("scene_id", "flow_type"))
    return left.groupBy("id").agg(F.count("scene_id").alias("n_scenes"), F.max("_d").alias("decision"))


_DEFAULTS = {"time_range": "last_24h", "object_scope": "network"}


@register(f"""{_G}, {_SC}, j AS (SELECT id, coalesce(context.scene, expected.scene) AS scene, contains(norm, '基站') AS site FROM g)
  SELECT id, coalesce(array_to_string(required, ','), '') AS required, concat_ws(',', CASE WHEN site THEN 'object_scope=site' WHEN list_contains(coalesce(required, []), 'object_scope') THEN 'object_scope=network' END,
    CASE WHEN list_contains(coalesce(required, []), 'time_range') THEN 'time_range=last_24h' END) AS slots FROM j LEFT JOIN sc ON scene = scene_id""")
def scene_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with its scene's required slots and defaults; nothing for an unknown scene."""
    known = scenes(spark, sf_dir)
    default = F.map_filter(F.create_map(*(F.lit(x) for kv in _DEFAULTS.items() for x in kv)), lambda k, v: F.array_contains("required_slots", k))
    r = requests(spark, sf_dir).select("id", F.coalesce("context.scene", "expected.scene").alias("scene_id"), F.create_map(F.lit("object_scope"), F.when(F.contains("norm", F.lit("基站")), "site")).alias("slots"))
    out = matching.with_scene(r, known.select("scene_id", "required_slots", default.alias("defaults")))
    return out.select("id", F.array_join("required_slots", ",").alias("required"), slots.sorted_text(slots.present(F.col("slots"))).alias("slots"))


_TEMPLATES = "tpl AS (SELECT trim(template_id) AS template_id, capability_id AS scene_id, priority FROM capability_intents WHERE coalesce(enabled, true) AND trim(coalesce(template_id, '')) <> '' AND trim(coalesce(case_id, '')) <> '')"


def _request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir).select("id", F.coalesce("context.scene", "expected.scene").alias("scene_id"))
    t = compiler.templates(table(spark, sf_dir, "capability_intents")).select("template_id", "scene_id")
    return matching.with_templates(r, t)


@register(f"{_G}, {_TEMPLATES} SELECT g.id, template_id FROM g JOIN tpl ON coalesce(context.scene, expected.scene) = scene_id")
def request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of each request's scene."""
    return _request_templates(spark, sf_dir).select("id", "template_id")


@register(f"""{_G}, {_TEMPLATES}, h AS (SELECT template_id, max(CASE WHEN priority % 2 = 0 THEN priority / 1000.0e0 END) AS score FROM tpl GROUP BY 1),
  j AS (SELECT DISTINCT g.id, template_id FROM g JOIN tpl ON coalesce(context.scene, expected.scene) = scene_id) SELECT id, template_id, round(coalesce(score, 0), 6) AS vector FROM j LEFT JOIN h USING (template_id)""")
def template_vector_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of each request with the score of its hits on them, 0 where there is none."""
    pairs = _request_templates(spark, sf_dir).select("id", "template_id").distinct()
    intents = table(spark, sf_dir, "capability_intents").where("coalesce(enabled, true)").select(F.trim("template_id").alias("template_id"), "priority", "case_id").where("priority % 2 = 0 and trim(case_id) <> ''")
    hits = pairs.join(intents, "template_id").select("id", "template_id", (F.col("priority") / 1000.0).alias("score"))
    return matching.with_vector(pairs, hits, "id", "template_id").select("id", "template_id", F.round("vector", 6).alias("vector"))


# ---------------------------------------------------------------- the whole way of a request

_BLOCK_WORDS, _UNKNOWN_WORDS, _UNSUPPORTED_WORDS, _ABSENT_WORDS, _DENIED = ["delete", "割接"], ["股票", "tarif"], ["u.s."], ["192.0.2."], ("viewer", ["cpu", "内存"])
_FLOWS = ["query", "report", "analysis"]
#: Slot of a scene and the entity that fills it.
_FILLED_BY = {"time_range": "time_range", "metric": "metric", "object_scope": "object_scope", "device_id": "device_ip", "region_id": "region_hint"}


def _permitted(df: DataFrame) -> DataFrame:
    """Blocked, unknown, unsupported, denied to the role, not at hand, in this order."""
    role, words = _DENIED
    rule = lambda ws, why: F.when(text.contains_any(F.col("norm"), ws), why)
    denied = F.when((F.col("role") == role) & text.contains_any(F.col("norm"), words), "permission_denied")
    return df.withColumn("_d", F.concat(F.lit("refuse:"), F.coalesce(rule(_BLOCK_WORDS, "policy_blocked"), rule(_UNKNOWN_WORDS, "unknown_domain"), rule(_UNSUPPORTED_WORDS, "unsupported_domain"), denied, rule(_ABSENT_WORDS, "data_unavailable"))))


def _in_scene(df: DataFrame) -> DataFrame:
    """The flow asked for or found, its scenes, and the gate over them."""
    one = -F.coalesce(F.col("left")[0]["minus"], F.lit(0.0))
    two = -F.coalesce(F.get("left", F.lit(1))["minus"], F.lit(0.0))
    # Whoever names a flow is taken at the best scene of it; others are asked if two are as good.
    g = F.when(F.col("context.flow_type").isNull(), ranking.gate(one, one - two, 0.3, 0.08)).otherwise(ranking.gate(one, one - two, 0.3, 0.0))
    options_ = F.array_join(F.transform(F.slice("left", 1, 3), lambda x: x["scene_id"]), "|")
    return df.withColumn("_d", F.when(F.col("flow").isNull(), "refuse:unknown_domain").when(F.size("left") == 0, "refuse:unsupported_domain").when(g == "refuse", "refuse:unsupported_domain").when(g == "clarify", F.concat(F.lit("clarify:scene:"), options_)))


def _routed(df: DataFrame) -> DataFrame:
    """Reports, templates that are good enough, missing slots within the rounds, else a query of its own."""
    names = lambda c: F.array_join(F.slice(c, 1, 2), ",")
    scene = F.col("left")[0]["scene_id"]
    asked = F.when(F.size("missing") > 0, F.when(slots.clarify_step(F.size("missing"), F.col("round"), F.lit(2)) == "exhausted", "refuse:rounds_exhausted").otherwise(F.concat(F.lit("clarify:"), names("missing"))))
    by_template = F.when(F.col("template_score") >= 0.8, F.coalesce(asked, F.concat(F.lit("route_template:"), "template_id")))
    return df.withColumn("_d", F.coalesce(F.when(F.col("flow") == "report", F.concat(F.lit("route_report:"), scene)), by_template, asked, F.concat(F.lit("route_nl2sql:"), scene)))


_TEMPLATE_BEST = """tb AS (SELECT scene_id, template_id, priority / 100.0e0 AS template_score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY priority DESC, template_id) AS rn FROM tpl) WHERE rn = 1)"""
_LACK = "list_filter(required, lambda s: " + " AND ".join(f"NOT (s = '{slot}' AND e_{entity})" for slot, entity in _FILLED_BY.items()) + ")"


def _any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@register(f"""{_SCORED}, {_TEMPLATES}, {_TEMPLATE_BEST},
  e AS (SELECT id, {_WORDS} IS NOT NULL AS e_time_range, ({_case_sql('low', extract.METRICS)}) IS NOT NULL AS e_metric, ({_case_sql('text', extract.SCOPES)}) IS NOT NULL AS e_object_scope, {_IP} IS NOT NULL AS e_device_ip, ({_case_sql('text', extract.REGIONS)}) IS NOT NULL AS e_region_hint FROM g),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, scene_id) AS rn FROM s),
  fl AS (SELECT g.id, coalesce(CASE WHEN lower(trim(context.flow_type)) IN ('query', 'report', 'analysis') THEN lower(trim(context.flow_type)) END, CASE WHEN rk.score > 0 THEN rk.flow END) AS flow FROM g LEFT JOIN rk ON g.id = rk.id AND rn = 1),
  lf AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, scene_id) AS rn FROM s JOIN fl ON s.id = fl.id AND s.flow = fl.flow),
  b AS (SELECT id, max(scene_id) FILTER (rn = 1) AS scene, max(score) FILTER (rn = 1) AS a, coalesce(max(score) FILTER (rn = 2), 0) AS b, string_agg(scene_id, '|' ORDER BY rn) FILTER (rn <= 3) AS top3 FROM lf GROUP BY 1),
  j AS (SELECT g.*, fl.flow AS flow, b.scene AS scene, b.a AS a, b.b AS b, b.top3 AS top3, tb.template_id AS template_id, tb.template_score AS template_score, e.* EXCLUDE (id), coalesce(sc.required, []) AS required, greatest(0, coalesce(TRY_CAST(context.clarify_round AS INTEGER), 0)) AS round
    FROM g JOIN fl ON g.id = fl.id LEFT JOIN b ON g.id = b.id LEFT JOIN tb ON tb.scene_id = b.scene LEFT JOIN sc ON sc.scene_id = b.scene JOIN e ON e.id = g.id),
  m AS (SELECT *, {_LACK} AS missing FROM j), n AS (SELECT *, CASE WHEN len(missing) > 0 THEN CASE WHEN round >= 2 THEN 'refuse:rounds_exhausted' ELSE 'clarify:' || array_to_string(missing[1:2], ',') END END AS asked FROM m)
  SELECT id, CASE WHEN length(trim(coalesce(text, ''))) < 2 OR length(trim(coalesce(norm, ''))) < 2 THEN 'clarify:input_text' WHEN length({trim_sql('text')}) > 1000 THEN 'refuse:too_long'
    WHEN {_any_of('norm', _BLOCK_WORDS)} THEN 'refuse:policy_blocked' WHEN {_any_of('norm', _UNKNOWN_WORDS)} THEN 'refuse:unknown_domain' WHEN {_any_of('norm', _UNSUPPORTED_WORDS)} THEN 'refuse:unsupported_domain'
    WHEN role = '{_DENIED[0]}' AND {_any_of('norm', _DENIED[1])} THEN 'refuse:permission_denied' WHEN {_any_of('norm', _ABSENT_WORDS)} THEN 'refuse:data_unavailable'
    WHEN flow IS NULL THEN 'refuse:unknown_domain' WHEN scene IS NULL OR a < 0.3 THEN 'refuse:unsupported_domain' WHEN context.flow_type IS NULL AND a - b < 0.08 THEN 'clarify:scene:' || top3
    WHEN flow = 'report' THEN 'route_report:' || scene WHEN template_score >= 0.8 THEN coalesce(asked, 'route_template:' || template_id) ELSE coalesce(asked, 'route_nl2sql:' || scene) END AS decision FROM n""")
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of every golden request over the configuration tables: guards, permissions, flow, scenes of the flow, gate,
    template, slots and rounds; one decision each. Scenes go along as an array, templates and required slots by checked joins."""
    r = scored_scenes(spark, sf_dir)
    found = F.when(-F.col("s")[0]["minus"] > 0, F.col("s")[0]["flow_type"])
    r = r.withColumn("flow", F.coalesce(routing.override_chain(_FLOWS, F.col("context.flow_type")), found))
    r = r.withColumn("left", F.filter("s", lambda x: x["flow_type"] == F.col("flow"))).drop("s").withColumn("scene_id", F.get("left", F.lit(0))["scene_id"])
    intents = table(spark, sf_dir, "capability_intents")
    priority = intents.select(F.trim("template_id").alias("template_id"), F.col("capability_id").alias("scene_id"), "priority").where("template_id <> ''").groupBy("scene_id", "template_id").agg(F.max("priority").alias("priority"))
    named = compiler.templates(intents).select("scene_id", "template_id").distinct().join(priority, ["scene_id", "template_id"])
    best = ranking.best_per_key(named, ["scene_id"], [F.col("priority").desc(), F.col("template_id")]).select("scene_id", "template_id", (F.col("priority") / 100.0).alias("template_score"))
    needed = scenes(spark, sf_dir).select("scene_id", "required_slots")
    r = r.join(F.broadcast(best) if is_small(best, 10_000) else best, "scene_id", "left").join(F.broadcast(needed), "scene_id", "left")  # scenes were counted
    entities = extract.extract_entities(F.col("text"), ZONE)
    have = F.array_compact(F.array(*(F.when(F.map_contains_key("e", F.lit(entity)), F.lit(slot)) for slot, entity in _FILLED_BY.items())))
    r = r.withColumn("e", entities).withColumn("missing", F.array_except(F.coalesce("required_slots", F.array().cast("array<string>")), have))
    r = r.withColumn("round", text.round_count(F.col("context.clarify_round"), 0, 0))
    return ranking.first_decision(r, [guard, _permitted, _in_scene, _routed]).select("id", "decision")


# ---------------------------------------------------------------- domains

_PRIORITY = {"device": 1.0, "region": 0.9, "metric": 0.8, "object_scope": 0.7}
_SCENE_DOMAINS = {"power.crosscheck": ["device", "metric"], "topo.breakdown": ["region"]}
_SLOT_DOMAINS = {"device_id": ["device"], "region_id": ["region", "object_scope"], "metric": ["metric"]}
_KEYWORDS = {"metric": ["cpu", "丢包", "latency"], "region": ["片区", "site"]}
_DEFAULT_DOMAINS = ["device", "region"]


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = domains.available_domains(table(spark, sf_dir, "ac_terms"), _PRIORITY)
    picked = domains.select_domains(F.col("text"), available, [F.col("context.scene"), F.col("expected.scene")], F.col("expected.missing_slots"), _SCENE_DOMAINS, _SLOT_DOMAINS, _KEYWORDS, _DEFAULT_DOMAINS)
    return table(spark, sf_dir, GOLDEN).where("text is not null").withColumn("picked", picked)


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _listed(c: str, lists: dict[str, list[str]]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in lists.items()) + " ELSE [] END"


def _ordered(lists: str) -> str:
    """SQL for the distinct elements of a list in order of first appearance."""
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)"


_ASKED = f"list_concat({_listed('context.scene', _SCENE_DOMAINS)}, {_listed('expected.scene', _SCENE_DOMAINS)}, flatten(list_transform(coalesce(expected.missing_slots, []), lambda s: {_listed('s', _SLOT_DOMAINS)})), " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in ws)} THEN ['{d}'] ELSE [] END" for d, ws in _KEYWORDS.items()) + ")"
_PICKED = f"""ch AS (SELECT id, CASE WHEN len(u) > 0 THEN u[1:2] ELSE {_list(_DEFAULT_DOMAINS)} END AS picked FROM (SELECT id, {_ordered('a')} AS u FROM (SELECT id, {_ASKED} AS a FROM {GOLDEN} WHERE text IS NOT NULL)))"""


@register(f"WITH {_PICKED} SELECT id, array_to_string(picked, ',') AS domains FROM ch")
def domain_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains each request is matched in: by scenes, held slots, words, defaults."""
    return _chosen(spark, sf_dir).select("id", F.array_join("picked", ",").alias("domains"))


_PRIO_SQL = "CASE domain " + " ".join(f"WHEN '{d}' THEN {p}" for d, p in _PRIORITY.items()) + " ELSE 0.0 END"
_NET_ORDER = "net DESC, prio DESC, (last - first + 1) DESC, first, domain, folded, entity_id"
_ARBITRATED = f"""{_SPELL}, {_PICKED}, v AS (SELECT m.*, coalesce(value, entity_id, folded) AS v, {_PRIO_SQL} AS prio,
    round(score - CASE WHEN len({_listed('slot', _SLOT_DOMAINS)}) = 0 OR list_contains({_listed('slot', _SLOT_DOMAINS)}, domain) THEN 0.0e0 ELSE 0.2e0 END, 9) AS net FROM m JOIN ch USING (id) WHERE list_contains(picked, domain)),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, slot, v ORDER BY {_NET_ORDER}) AS r1 FROM v) WHERE r1 = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, slot ORDER BY {_NET_ORDER}, v) AS rk FROM b)"""


def _arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = domains.matches_by_domain(_chosen(spark, sf_dir), "id", "text", "picked", dictionary.patterns(table(spark, sf_dir, "ac_terms")))
    return domains.arbitrated(found, "id", _PRIORITY, _SLOT_DOMAINS)


@register(f"{_ARBITRATED} SELECT id, slot, v AS value, domain, round(net, 6) AS net, CAST(rk AS BIGINT) AS rank FROM k")
def domain_arbiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranked answer per slot and value out of several domains."""
    return _arbitrated(spark, sf_dir).select("id", "slot", F.col("value_").alias("value"), "domain", F.round("net", 6).alias("net"), F.col("rank").cast("bigint").alias("rank"))


@register(f"""{_ARBITRATED}, per AS (SELECT id, slot, max(v) FILTER (rk = 1) AS value, max(score) FILTER (rk = 1) AS a, max(score) FILTER (rk = 2) AS b,
    string_agg(coalesce(entity_id, v) || ':' || coalesce(entity_name, folded), '|' ORDER BY rk) FILTER (rk <= 3) AS c FROM k GROUP BY 1, 2),
  held AS (SELECT id, unnest(expected.missing_slots) AS slot FROM {GOLDEN})
  SELECT per.id, per.slot, value, a >= 0.8 AND a - coalesce(b, 0) >= 0.05 AND held.slot IS NULL AS committed, CASE WHEN per.slot IN ('device_id', 'region_id') THEN c END AS candidates FROM per LEFT JOIN (SELECT DISTINCT * FROM held) held ON per.id = held.id AND per.slot = held.slot""")
def prefill_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dictionary fills in: sure values of slots that are not held, and candidates to choose from."""
    held = table(spark, sf_dir, GOLDEN).select("id", F.explode("expected.missing_slots").alias("slot")).distinct()
    best = domains.best_by_domain(_chosen(spark, sf_dir), "id", "text", "picked", dictionary.patterns(table(spark, sf_dir, "ac_terms")), _SLOT_DOMAINS, 3)
    out = domains.prefilled(domains.arbitrated(best, "id", _PRIORITY, _SLOT_DOMAINS), "id", held, 0.8, 0.05)
    return out.select("id", "slot", "value", "committed", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["entity_id"], c["name"])), "|").alias("candidates"))


@register(f"""{_SPELL}, a AS (SELECT id, entity_id, score, first * 100000 + last AS ord, 0 AS f FROM m WHERE slot = 'device_id' UNION ALL SELECT id, entity_id, score, first * 100000 + last, 1 FROM m WHERE slot = 'region_id')
  SELECT id, entity_id, score, CAST(f AS BIGINT) AS origin FROM (SELECT *, row_number() OVER (PARTITION BY id, entity_id ORDER BY score DESC, f, ord) AS rn FROM a) WHERE rn = 1""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two slots as one list, the best of each entity."""
    m = _matches(spark, sf_dir).select("id", "slot", "entity_id", F.col("entity_name").alias("name"), "score", (F.col("first") * 100000 + F.col("last")).alias("ord"))
    of = lambda s, n: m.where(F.col("slot") == s).drop("slot").withColumn("origin", F.lit(n).cast("bigint"))
    return domains.merged_candidates(of("device_id", 0), of("region_id", 1), ["id"]).select("id", "entity_id", "score", "origin")


# ---------------------------------------------------------------- options

_BLOCKED = ["日志", "report"]


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with templates (labels of intents) and actions (descriptions of capabilities) to offer."""
    items = table(spark, sf_dir, "capability_intents").select(F.col("capability_id").alias("scene_id"), F.substring("intent_id", -9, 9).try_cast("bigint").alias("ord"), "label", F.col("capability_id").alias("intent"))
    acts = scenes(spark, sf_dir).select("scene_id", F.crc32(F.encode("scene_id", "utf-8")).alias("ord"), F.col("description").alias("label"), F.lit("action").alias("intent"))
    r = requests(spark, sf_dir).select("id", "expected", F.coalesce("context.scene", "expected.scene").alias("scene"))
    r = options.scene_first(r, "scene", items, 3, "templates", _BLOCKED)
    return options.scene_first(r, "scene", acts, 2, "actions", _BLOCKED)


_ITEMS = f"""it AS (SELECT capability_id AS scene_id, CAST(right(intent_id, 9) AS BIGINT) AS ord, trim(coalesce(label, '')) AS label FROM capability_intents WHERE trim(coalesce(label, '')) <> '' AND {' AND '.join(f"NOT contains(lower(coalesce(label, '')), '{w}')" for w in _BLOCKED)}),
  rq AS (SELECT id, coalesce(context.scene, expected.scene) AS scene FROM {GOLDEN}),
  own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord) AS rn FROM it WHERE scene_id IS NOT NULL) WHERE rn <= 3),
  whole AS (SELECT * FROM it ORDER BY ord LIMIT 6),
  un AS (SELECT id, own.label, 0 AS k, ord FROM rq JOIN own ON scene = scene_id UNION ALL SELECT id, whole.label, 1, ord FROM rq JOIN whole ON scene IS NULL OR whole.scene_id IS NULL OR whole.scene_id <> scene),
  fin AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, ord) AS rn FROM un)"""


@register(f"WITH {_ITEMS} SELECT id, string_agg(label, '|' ORDER BY rn) AS labels FROM fin WHERE rn <= 3 GROUP BY id")
def options_scene_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three templates for each request, those of its own scene before others, without blank and blocked labels."""
    return _offers(spark, sf_dir).select("id", F.array_join(F.transform("templates", lambda o: o["label"]), "|").alias("labels"))


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six ways to put together the options of a refusal."""
    fallback, edge, later = options.option("capabilities", "capability.list"), options.option("limits", "capability.list"), options.option("later", None)
    t, a = F.col("templates"), F.col("actions")
    few = F.slice(t, 1, 2)
    sequences = {"policy_blocked": [few, F.array(fallback)], "permission_denied": [t, a, F.array(fallback)], "out_of_seed_scope": [t, a, F.array(edge)], "data_unavailable": [F.array(later), t], "unknown_domain": [F.array(fallback), t]}
    return _offers(spark, sf_dir).withColumn("options", options.by_reason(F.col("expected.out_of_scope_reason"), sequences, [t, a, F.array(fallback)], fallback))


_ACTS = f"""ac AS (SELECT capability_id AS scene_id, description AS label, row_number() OVER (PARTITION BY capability_id ORDER BY created_at DESC NULLS LAST, version DESC) AS rn FROM capabilities WHERE coalesce(enabled, true) AND capability_id IS NOT NULL)"""


@register(f"""WITH {_ITEMS}, tl AS (SELECT id, list(struct_pack(label := label, rn := rn) ORDER BY rn) AS t FROM fin WHERE rn <= 3 GROUP BY id)
  SELECT g.id, expected.out_of_scope_reason AS reason, CAST(CASE expected.out_of_scope_reason WHEN 'policy_blocked' THEN 1 + len(list_distinct(list_transform(t[1:2], lambda x: x.label))) WHEN 'unknown_domain' THEN 1 + len(list_distinct(list_transform(t, lambda x: x.label))) WHEN 'data_unavailable' THEN 1 + len(list_distinct(list_transform(t, lambda x: x.label))) ELSE 4 END AS BIGINT) AS n
  FROM {GOLDEN} g JOIN tl USING (id) WHERE len(list_distinct(list_transform(t, lambda x: x.label))) = 3""")
def refusal_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many options each reason gives, of requests that have three different templates."""
    r = _refusals(spark, sf_dir).where(F.size(F.array_distinct(F.transform("templates", lambda o: o["label"]))) == 3)
    return r.select("id", F.col("expected.out_of_scope_reason").alias("reason"), F.size("options").cast("bigint").alias("n"))


_PRESETS = {"time_range": ["last_24h", "last_7d", "today"], "topn": ["5", "10", "20"]}


@register(f"""{_SPELL}, cand AS (SELECT id, slot, label, row_number() OVER (PARTITION BY id, slot ORDER BY score DESC, first, last, folded, entity_id) AS rn FROM (SELECT id, slot, score, first, last, folded, entity_id, coalesce(nullif(entity_name, ''), entity_id) AS label FROM m)),
  w AS (SELECT id, unnest(expected.missing_slots) AS slot FROM {GOLDEN})
  SELECT w.id, w.slot, CASE w.slot WHEN 'time_range' THEN 'last_24h|last_7d|today' WHEN 'topn' THEN '5|10|20' ELSE coalesce(string_agg(label, '|' ORDER BY rn), 'give ' || w.slot) END AS options
  FROM w LEFT JOIN cand ON w.id = cand.id AND w.slot = cand.slot AND rn <= 3 GROUP BY w.id, w.slot""")
def slot_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options for each missing slot: presets, candidates from the dictionary, or a plain question."""
    best = ranking.top_k(_matches(spark, sf_dir), ["id", "slot"], [F.col("score").desc(), F.col("first"), F.col("last"), F.col("folded"), F.col("entity_id")], 3)
    lists = best.groupBy("id", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("entity_name").alias("name"), "entity_id"))).alias("c"))
    asked = table(spark, sf_dir, GOLDEN).select("id", F.explode("expected.missing_slots").alias("slot")).distinct()
    offered = options.for_slot(F.col("slot"), _PRESETS, F.col("c"))
    return asked.join(lists, ["id", "slot"], "left").select("id", "slot", F.array_join(F.transform(offered, lambda o: o["label"]), "|").alias("options"))


# ---------------------------------------------------------------- constraints


@register("""SELECT 'capability_keys' AS rule, coalesce(capability_id, '') AS key, CAST(count(*) AS BIGINT) AS n FROM capabilities WHERE trim(coalesce(capability_id, '')) = '' OR description IS NULL OR keywords IS NULL OR required_slots IS NULL GROUP BY 2
  UNION ALL SELECT 'capability_unique', capability_id, count(*) FROM capabilities WHERE trim(coalesce(capability_id, '')) <> '' GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'capability_flow', capability_id, count(*) FROM capabilities WHERE coalesce(lower(trim(flow_type)), 'query') NOT IN ('query', 'report', 'direct', 'unknown') GROUP BY 2
  UNION ALL SELECT 'intent_case', intent_id, count(*) FROM capability_intents WHERE trim(coalesce(case_id, '')) = '' GROUP BY 2
  UNION ALL SELECT 'intent_unique', coalesce(capability_id, '') || '/' || trim(case_id), count(*) FROM capability_intents WHERE trim(coalesce(case_id, '')) <> '' GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'intent_text', intent_id, count(*) FROM capability_intents WHERE length(coalesce(nullif(trim(text), ''), nullif(trim(label), ''), '')) < 2 GROUP BY 2
  UNION ALL SELECT 'template_unique', coalesce(capability_id, '') || '/' || trim(template_id), count(*) FROM capability_intents WHERE trim(coalesce(template_id, '')) <> '' GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'template_scene', trim(template_id), count(*) FROM capability_intents i WHERE trim(coalesce(template_id, '')) <> '' AND capability_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.capability_id = i.capability_id) GROUP BY 2
  UNION ALL SELECT 'seed_case', CAST(row_id AS VARCHAR), count(*) FROM seed_cases_template WHERE trim(coalesce(case_id, '')) = '' GROUP BY 2
  UNION ALL SELECT 'seed_scene', CAST(row_id AS VARCHAR), count(*) FROM seed_cases_template s WHERE scene_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.capability_id = s.scene_id) GROUP BY 2
  UNION ALL SELECT 'seed_text', CAST(row_id AS VARCHAR), count(*) FROM seed_cases_template WHERE length(trim(coalesce(text, ''))) < 2 GROUP BY 2
  UNION ALL SELECT * FROM (VALUES ('thresholds', 'T_scene', CAST(1 AS BIGINT)), ('vector', 'fusion.scene', 1), ('vector', 'search_backend', 1), ('vector', 'seed_case_topk', 1), ('embedding', 'timeout_ms', 1), ('rules', 'blocked_words', 1)) t(rule, key, n)""")
def config_all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All validators: capabilities, scenes, intents, templates and seeds as tables, and four documents that were spoilt in one place each or two."""
    spoilt = {"thresholds": {"T_scope": 0.52, "T_scene": 1.2}, "vector": {"scene_topk": 5, "template_topk": 5, "seed_case_topk": 0, "search_backend": "lucene", "fusion_weights": {"scene": {"rule": 0.5, "vector": 0.6}, "template": {"rule": 0.5, "vector": 0.5}}, "embedding": {"provider": "local", "model": "m", "dimension": 8, "timeout_ms": 5}}, "rules": {"max_input_chars": 1000, "blocked_words": "noc"}}
    of_tables = constraints.table_violations(table(spark, sf_dir, "capabilities"), table(spark, sf_dir, "capability_intents"), table(spark, sf_dir, "seed_cases_template"))
    return of_tables.unionByName(constraints.document_violations(spark, spoilt))


QUERIES, SQL = register.queries, register.sql

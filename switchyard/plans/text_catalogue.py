"""Queries of the text operators: normalising, guards, tokens, extraction, scoring, gates, dictionary matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import scoring, text
from switchyard.operators import dictionary, ranking
from switchyard.plans.registry import Register
from switchyard.session import spread, table

register = Register()
GOLDEN, REGRESSION = "network_ops_business_golden_v1", "network_ops_regression_local_fallback_v1"

#: Demonstration scenes over `documents`: languages, by frequent words.
SCENES = {"en": ["the", "of", "and", "that"], "de": ["der", "die", "das", "und"], "fr": ["la", "le", "que", "les"], "es": ["el", "los", "las", "en"]}
NEGATIVE = {"en": ["photo"], "de": ["foto"], "fr": ["photo"], "es": ["foto"]}
#: Words for a time range, in the order in which they are tried.
PRESETS = [(["近24小时", "24小时"], "last_24h"), (["近7天"], "last_7d"), (["近14天"], "last_14d"), (["近30天"], "last_30d"), (["近90天"], "last_90d"), (["今天"], "today"), (["昨天"], "yesterday"), (["本周"], "this_week")]
POLICY = [(["noc"], "blocked"), (["weather", "股票"], "unknown"), (["u.s."], "unsupported"), (["192.0.2."], "unavailable")]

_S = text.SPACE
_TRIM = f"regexp_replace(@, '^{_S}+|{_S}+$', '', 'g')"
_NORM = f"regexp_replace(translate(lower({_TRIM}), '，。？！', '    '), '{_S}+', ' ', 'g')"
_TOKENS = f"list_distinct(list_filter(string_split_regex(lower(@), '{text.TOKEN_SPLIT}'), lambda x: x <> ''))"


def trim_sql(c: str) -> str:
    return _TRIM.replace("@", c)


def norm_sql(c: str) -> str:
    return _NORM.replace("@", c)


def tokens_sql(c: str) -> str:
    return _TOKENS.replace("@", c)


def _any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _case_sql(c: str, rules: list[tuple[list[str], str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(c, ws)} THEN '{v}'" for ws, v in rules) + " END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("*", text.normalize_text(F.col("text")).alias("norm"))


_DOCS = f"WITH d AS (SELECT doc_id, text, lang, source, {norm_sql('text')} AS norm FROM documents)"


@register(f"{_DOCS} SELECT doc_id, norm FROM d")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "norm")


def guard(df: DataFrame) -> DataFrame:
    """Adds _d: clarify for fewer than 2 characters, refuse for more than 1000, else null."""
    raw, short = F.coalesce(text.uni_trim(F.col("text")), F.lit("")), F.coalesce(text.uni_trim(F.col("norm")), F.lit(""))
    return df.withColumn("_d", F.when((F.length(raw) < 2) | (F.length(short) < 2), "clarify:input_text").when(F.length(raw) > 1000, "refuse:too_long"))


_GUARD = f"CASE WHEN length(coalesce({trim_sql('text')}, '')) < 2 OR length(coalesce({trim_sql('norm')}, '')) < 2 THEN 'clarify:input_text' WHEN length(coalesce({trim_sql('text')}, '')) > 1000 THEN 'refuse:too_long' END"


@register(f"{_DOCS} SELECT doc_id, {_GUARD} AS decision FROM d")
def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard(documents(spark, sf_dir)).select("doc_id", F.col("_d").alias("decision"))


def policy(df: DataFrame) -> DataFrame:
    return df.withColumn("_d", F.concat(F.lit("refuse:"), text.first_match(F.col("norm"), POLICY)))


_POLICY = f"'refuse:' || ({_case_sql('norm', POLICY)})"


@register(f"{_DOCS} SELECT doc_id, {_POLICY} AS decision FROM d")
def policy_guard_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy(documents(spark, sf_dir)).select("doc_id", F.col("_d").alias("decision"))


_RULES = [("viewer", "告警"), ("viewer", "latency"), ("guest", "cpu"), ("operator", "top")]


@register(f"""SELECT g.id, CAST(count(*) AS BIGINT) AS n_rules FROM {GOLDEN} g JOIN (VALUES {", ".join(f"('{r}', '{k}')" for r, k in _RULES)}) r(role, keyword)
  ON g.role = r.role AND contains(lower(g.text), r.keyword) GROUP BY g.id""")
def permission_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose role is denied one of their words: equal role, keyword as a substring."""
    rules = spark.createDataFrame(_RULES, "role string, keyword string")
    asked = table(spark, sf_dir, GOLDEN).select("id", "role", F.lower("text").alias("low"))
    return asked.join(F.broadcast(rules), (asked.role == rules.role) & F.contains("low", "keyword")).groupBy("id").agg(F.count("*").alias("n_rules"))


@register(f"SELECT intent_id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS tokens FROM capability_intents WHERE text IS NOT NULL")
def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "capability_intents").where("text is not null").select("intent_id", F.array_join(F.array_sort(text.tokenize(F.col("text"))), " ").alias("tokens"))


def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: a row per document and scene with its keyword overlap and ordinal. The scenes are literals, so nothing is joined."""
    rows = F.array(*(F.struct(F.lit(s).alias("scene"), F.lit(i).alias("ord"), F.array(*map(F.lit, ws)).alias("keywords"), F.array(*map(F.lit, NEGATIVE[s])).alias("negative")) for i, (s, ws) in enumerate(SCENES.items())))
    d = documents(spark, sf_dir).withColumn("tokens", text.tokenize(F.col("norm"))).select("*", F.inline(rows))
    return d.withColumn("overlap", scoring.keyword_overlap(F.col("norm"), F.col("tokens"), F.col("keywords")))


_SCENE_ROWS = "(VALUES " + ", ".join(f"('{s}', {i}, {ws!r}, {NEGATIVE[s]!r})" for i, (s, ws) in enumerate(SCENES.items())) + ") s(scene, ord, keywords, negative)"
_OVERLAP = f"""{_DOCS}, t AS (SELECT *, coalesce({tokens_sql('norm')}, []) AS tokens FROM d),
  sc AS (SELECT t.*, s.*, CASE WHEN len(tokens) > 0 THEN least(1.0e0, len(list_filter(keywords, lambda k: list_contains(tokens, k) OR contains(norm, k))) / 4.0e0) ELSE 0.0e0 END AS overlap FROM t CROSS JOIN {_SCENE_ROWS})"""


@register(f"{_OVERLAP} SELECT doc_id, scene, round(overlap, 6) AS overlap FROM sc")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_scores(spark, sf_dir).select("doc_id", "scene", F.round("overlap", 6).alias("overlap"))


_PHRASES = ["as agreed", "around", "the shift", "no packets"]


@register(f"""{_DOCS}, h AS (SELECT doc_id, {" + ".join(f"CASE WHEN contains(norm, '{p}') THEN 1 ELSE 0 END" for p in _PHRASES)} AS n FROM d)
  SELECT doc_id, CASE WHEN n IS NULL OR n = 0 THEN 0.0e0 ELSE round(least(1.0e0, 0.4e0 + 0.2e0 * n), 6) END AS score FROM h""")
def entry_phrase_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(F.coalesce(scoring.entry_phrase_score(F.col("norm"), _PHRASES), F.lit(0.0)), 6).alias("score"))


_FLOWS = {"en": "query", "de": "query", "fr": "report", "es": "report"}
_FLOW_SQL = "CASE WHEN scene IN ('en', 'de') THEN 'query' ELSE 'report' END"


@register(f"""{_OVERLAP}, f AS (SELECT doc_id, {_FLOW_SQL} AS flow, max(overlap) AS score, min(ord) AS ord FROM sc GROUP BY 1, 2)
  SELECT doc_id, flow, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS BIGINT) AS rank FROM f""")
def flow_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = F.when(F.col("scene").isin("en", "de"), "query").otherwise("report")
    per = scene_scores(spark, sf_dir).groupBy("doc_id", flow.alias("flow")).agg(F.max("overlap").alias("score"), F.min("ord").alias("ord"))
    return ranking.top_k(per, ["doc_id"], [F.col("score").desc(), F.col("ord")], 9).select("doc_id", "flow", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlap, the length of the text and the presence of negative words, fused with weights .35, .45, .20."""
    s = scene_scores(spark, sf_dir)
    length = F.coalesce(F.length("norm"), F.lit(0)) / 2000.0
    clean = F.when(F.exists("negative", lambda k: F.coalesce(F.contains("norm", k), F.lit(False))), 0.4).otherwise(1.0)
    return s.withColumn("score", scoring.weighted_score([(0.35, F.col("overlap")), (0.45, length), (0.20, clean)]))


_FUSED = f"""{_OVERLAP}, fs AS (SELECT *, least(1.0e0, 0.35e0 * overlap + 0.45e0 * least(1.0e0, coalesce(length(norm), 0) / 2000.0e0)
  + 0.2e0 * CASE WHEN len(list_filter(negative, lambda k: coalesce(contains(norm, k), false))) > 0 THEN 0.4e0 ELSE 1.0e0 END) AS score FROM sc)"""


@register(f"{_FUSED} SELECT doc_id, scene, round(score, 6) AS score FROM fs")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_scores(spark, sf_dir).select("doc_id", "scene", F.round("score", 6).alias("score"))


def scope_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scene_scores(spark, sf_dir)
    best = ranking.top_gap(s, ["doc_id"], "scene", "overlap", "ord")
    return best.withColumn("decision", ranking.gate(F.col("top1_score"), F.col("gap"), 0.5, 0.25))


_GAPS = f"""{_OVERLAP}, r AS (SELECT doc_id, scene, overlap, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, ord) AS rn FROM sc),
  g AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN scene END) AS top1, max(CASE WHEN rn = 1 THEN overlap END) AS s1, max(CASE WHEN rn = 2 THEN overlap END) AS s2 FROM r GROUP BY doc_id),
  gate AS (SELECT *, CASE WHEN s1 < 0.5 THEN 'refuse' WHEN s1 - s2 < 0.25 THEN 'clarify' ELSE 'pass' END AS decision FROM g)"""


@register(f"{_GAPS} SELECT doc_id, top1, round(s1, 6) AS top1_score, round(s1 - s2, 6) AS gap, decision FROM gate")
def scope_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_gaps(spark, sf_dir).select("doc_id", "top1", F.round("top1_score", 6).alias("top1_score"), F.round("gap", 6).alias("gap"), "decision")


_EXAMPLES = ["查今天机房核心交换机的丢包率", "Show latency of core switch for the last 24 hours", "统计本周片区基站的会话数峰值变化"]


@register()
def example_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matching-block similarity of each distinct request to the examples; no SQL has it, tests compare with difflib."""
    asked = table(spark, sf_dir, GOLDEN).select(text.normalize_text(F.col("text")).alias("norm")).where("norm is not null").distinct()
    pairs = asked.select("norm", F.posexplode(F.array(*map(F.lit, _EXAMPLES))).alias("ord", "example"))
    scored = pairs.withColumn("score", scoring.sequence_ratio("norm", "example"))
    return ranking.best_per_key(scored, ["norm"], [F.col("score").desc(), F.col("ord")]).select("norm", "example", F.round("score", 6).alias("score"))


@register(f"SELECT doc_id, nullif(regexp_extract(text, '(^|[^0-9])(([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})([^0-9]|$)', 2), '') AS ip FROM documents WHERE text IS NOT NULL")
def extract_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.extract_ip(F.col("text")).alias("ip"))


_N = "nullif(regexp_extract(translate(text, '０１２３４５６７８９', '0123456789'), '@', 1), '')"


@register(f"SELECT id, CASE WHEN try_cast({_N.replace("@", '(?i)(?:top[ ]*|前)([0-9]+)')} AS BIGINT) BETWEEN 1 AND 1000 THEN try_cast({_N.replace("@", '(?i)(?:top[ ]*|前)([0-9]+)')} AS BIGINT) END AS topn FROM {GOLDEN}")
def extract_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, GOLDEN).select("id", text.extract_topn(F.col("text")).alias("topn"))


_SHARE = "text || CASE WHEN doc_id % 3 = 0 THEN ' 超过 ' WHEN doc_id % 3 = 1 THEN ' >' ELSE ' 大于' END || (doc_id % 130) || '.5 %'"


@register(f"SELECT doc_id, CASE WHEN v BETWEEN 0 AND 100 THEN v END AS percent FROM (SELECT doc_id, try_cast({_N.replace('text', _SHARE).replace('@', '(?:>|大于|超过)[ ]*([0-9]+(?:[.][0-9]+)?)[ ]*%')} AS DOUBLE) AS v FROM documents)")
def extract_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that a text names; each text has one added, so that there is something to find."""
    mark = F.when(F.col("doc_id") % 3 == 0, " 超过 ").when(F.col("doc_id") % 3 == 1, " >").otherwise(" 大于")
    longer = F.concat("text", mark, (F.col("doc_id") % 130).cast("string"), F.lit(".5 %"))
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_percent(longer).alias("percent"))


@register(f"SELECT id, {_case_sql(norm_sql('text'), PRESETS)} AS preset, length(text) AS n_chars FROM {GOLDEN}")
def ordered_case_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, GOLDEN).select("id", text.first_match(text.normalize_text(F.col("text")), PRESETS).alias("preset"), F.length("text").cast("bigint").alias("n_chars"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.json_path(F.col("props"), "$.k").alias("k"))


@register("""SELECT row_id, json_extract_string(slots_json, '$.object_scope') AS object_scope, json_extract_string(slots_json, '$.time_range.preset') AS preset, TRY_CAST(json_extract_string(slots_json, '$.topn') AS BIGINT) AS topn FROM seed_cases_template""")
def slots_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = text.repaired_json(F.col("slots_json"))
    return table(spark, sf_dir, "seed_cases_template").select("row_id", text.json_path(j, "$.object_scope").alias("object_scope"), text.json_path(j, "$.time_range.preset").alias("preset"), text.json_path(j, "$.topn").try_cast("bigint").alias("topn"))


@register(f"""{_OVERLAP} SELECT doc_id, scene, round(CASE WHEN len(list_filter(negative, lambda k: coalesce(contains(norm, k), false))) > 0 THEN 0.0e0 ELSE overlap END, 6) AS rule FROM sc""")
def negative_keyword_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.exists("negative", lambda k: F.coalesce(F.contains("norm", k), F.lit(False)))
    return scene_scores(spark, sf_dir).select("doc_id", "scene", F.round(F.when(hit, 0.0).otherwise(F.col("overlap")), 6).alias("rule"))


@register(f"""{_FUSED} SELECT doc_id, scene, round(score, 6) AS score, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS rn FROM fs) WHERE rn <= 2""")
def template_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(fused_scores(spark, sf_dir), ["doc_id"], [F.round("score", 9).desc(), F.col("ord")], 2)
    return best.select("doc_id", "scene", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_SHORT = f"coalesce({_GUARD}, {_POLICY})"


@register(f"{_DOCS} SELECT doc_id, coalesce({_SHORT}, 'route') AS decision FROM d")
def pipeline_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ranking.first_decision(documents(spark, sf_dir), [guard, policy])
    return d.select("doc_id", F.coalesce("decision", F.lit("route")).alias("decision"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: guards, scene scores, gap gate and the decision of every document; exactly one row each.

    The wide form: the scenes are literals, scored in an array and ranked by array_sort, so nothing moves.
    """
    d = documents(spark, sf_dir).withColumn("tokens", text.tokenize(F.col("norm")))
    scored = F.array(*(F.struct((-scoring.keyword_overlap(F.col("norm"), F.col("tokens"), F.array(*map(F.lit, ws)))).alias("minus"), F.lit(i).alias("ord"), F.lit(s).alias("scene")) for i, (s, ws) in enumerate(SCENES.items())))
    d = d.withColumn("_best", F.explode(F.array(F.slice(F.array_sort(scored), 1, 2))))
    one, two = -F.col("_best")[0]["minus"], -F.col("_best")[1]["minus"]

    def scope(df: DataFrame) -> DataFrame:
        g = ranking.gate(one, one - two, 0.5, 0.25)
        return df.withColumn("_d", F.when(g == "refuse", "refuse:unsupported").when(g == "clarify", "clarify:scene").otherwise(F.concat(F.lit("route:"), F.col("_best")[0]["scene"])))

    return ranking.first_decision(d, [guard, policy, scope]).select("doc_id", "lang", "source", F.col("_best")[0]["scene"].alias("scene"), F.round(one, 6).alias("score"), "decision")


_ROUTED = f"""{_GAPS}, routed AS (SELECT d.doc_id, d.lang, d.source, top1 AS scene, round(s1, 6) AS score,
  coalesce({_SHORT}, CASE gate.decision WHEN 'refuse' THEN 'refuse:unsupported' WHEN 'clarify' THEN 'clarify:scene' ELSE 'route:' || top1 END) AS decision FROM d JOIN gate USING (doc_id))"""


@register(f"{_ROUTED} SELECT doc_id, scene, score, decision FROM routed")
def route_pipeline_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("doc_id", "scene", "score", "decision")


_SPELL = """WITH s AS (SELECT *, unnest(list_distinct(list_transform(list_concat([term], coalesce(aliases, [])), lambda x: {trim}))) AS pattern FROM ac_terms),
  p AS (SELECT lower(pattern) AS folded, domain, slot, value, entity_id, entity_name, greatest(0, least(1, coalesce(score, 0))) AS score, word_boundary, pattern, term FROM s WHERE length(pattern) >= 2),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folded, domain, slot, value, entity_id ORDER BY score DESC, pattern, term, entity_name NULLS FIRST) AS rn FROM p) WHERE rn = 1),
  f AS (SELECT DISTINCT folded FROM best),
  t AS (SELECT id, text, lower(text) AS low FROM {golden} WHERE text IS NOT NULL),
  c AS (SELECT t.*, f.folded FROM t JOIN f ON contains(t.low, f.folded)),
  o AS (SELECT *, unnest(generate_series(1, length(low) - length(folded) + 1)) AS first FROM c),
  h AS (SELECT id, folded, first, first + length(folded) - 1 AS last,
    (first > 1 AND regexp_matches(substr(text, CAST(first - 1 AS BIGINT), 1), '[0-9A-Za-z_]')) OR regexp_matches(substr(text, CAST(first + length(folded) AS BIGINT), 1), '[0-9A-Za-z_]') AS inside
    FROM o WHERE substr(low, CAST(first AS BIGINT), length(folded)) = folded),
  m AS (SELECT h.id, h.first, h.last, best.* FROM h JOIN best USING (folded)
    WHERE NOT (coalesce(word_boundary, NOT regexp_matches(folded, '[^\\x00-\\x7f]')) AND inside))""".replace("{trim}", trim_sql("x")).replace("{golden}", GOLDEN)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.find_terms(table(spark, sf_dir, GOLDEN).where("text is not null"), "id", "text", dictionary.patterns(table(spark, sf_dir, "ac_terms")))


@register(f"{_SPELL} SELECT id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, folded, domain, slot, entity_id, score FROM m")
def dictionary_match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of all dictionary spellings in the golden texts."""
    return _matches(spark, sf_dir).select("id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "folded", "domain", "slot", "entity_id", "score")


_PRIORITY = {"device": 1.0, "region": 0.9, "metric": 0.8, "object_scope": 0.7}
_PRIO_SQL = "CASE domain " + " ".join(f"WHEN '{d}' THEN {p}" for d, p in _PRIORITY.items()) + " ELSE 0.5 END"
_RANK_SQL = "score DESC, prio DESC, (last - first + 1) DESC, first, domain NULLS FIRST, folded"


@register(f"""{_SPELL}, v AS (SELECT *, coalesce(value, entity_id, folded) AS slot_value, {_PRIO_SQL} AS prio FROM m),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, slot, slot_value ORDER BY {_RANK_SQL}) AS r1 FROM v) WHERE r1 = 1)
  SELECT id, slot, slot_value, score, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, slot ORDER BY {_RANK_SQL}, slot_value) AS rk FROM b) WHERE rk <= 3""")
def prefill_dedup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dictionary.best_values(table(spark, sf_dir, GOLDEN).where("text is not null"), "id", "text", dictionary.patterns(table(spark, sf_dir, "ac_terms")), _PRIORITY, 3)
    return best.select("id", "slot", "slot_value", "score", F.col("rank").cast("bigint").alias("rank"))


@register(f"""{_SPELL}, v AS (SELECT id, slot, domain, folded, first, round(score - CASE WHEN slot = 'metric' AND coalesce(domain, '') <> 'metric' THEN 0.2e0 ELSE 0.0e0 END, 6) AS net FROM m)
  SELECT id, slot, domain, folded, net FROM (SELECT *, row_number() OVER (PARTITION BY id, slot ORDER BY net DESC, first, folded, domain) AS rn FROM v) WHERE rn = 1""")
def arbiter_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.when(F.col("slot") == "metric", F.array(F.lit("metric")))
    net = F.round(dictionary.penalised(F.col("score"), F.coalesce("domain", F.lit("")), allowed), 6)
    m = _matches(spark, sf_dir).withColumn("net", net)
    return ranking.best_per_key(m, ["id", "slot"], [F.col("net").desc(), F.col("first"), F.col("folded"), F.col("domain")]).select("id", "slot", "domain", "folded", "net")


@register(f"{_SPELL} SELECT id, domain, CAST(count(*) AS BIGINT) AS n_matches FROM m GROUP BY 1, 2")
def domain_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.n_domains(_matches(spark, sf_dir), "id")


@register(f"""SELECT id, array_to_string(list_filter(CASE WHEN contains(lower(text), 'cpu') THEN ['metric', 'device'] WHEN contains(text, '告警') THEN ['region', 'metric', 'device'] ELSE ['device', 'region'] END,
  lambda x: true)[1:2], ',') AS domains FROM {GOLDEN} WHERE text IS NOT NULL""")
def domain_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two domains of a request: by keywords, then defaults, each once and in order."""
    by_word = F.when(F.contains(F.lower("text"), F.lit("cpu")), F.array(F.lit("metric"), F.lit("device"))).when(F.contains("text", F.lit("告警")), F.array(F.lit("region"), F.lit("metric")))
    chosen = ranking.ordered_union(2, by_word, F.array(F.lit("device"), F.lit("region")))
    return table(spark, sf_dir, GOLDEN).where("text is not null").select("id", F.array_join(chosen, ",").alias("domains"))


_FIELDS = ["term", "domain", "slot", "value", "entity_id"]
_KEY = "lower(concat_ws('|', " + ", ".join(f"c_{c}" for c in ("domain", "slot", "value", "entity_id", "term")) + "))"


@register(f"""WITH c AS (SELECT *, {", ".join(f"coalesce({trim_sql(c)}, '') AS c_{c}" for c in _FIELDS)} FROM ac_terms),
  k AS (SELECT *, {_KEY} AS key FROM c WHERE length(c_term) >= 1 AND c_slot <> ''),
  h AS (SELECT key, arg_min(c_term, term_id) AS term, arg_min(c_slot, term_id) AS slot, max(greatest(0, least(1, coalesce(score, 0.99)))) AS score, arg_min(word_boundary, term_id) FILTER (word_boundary IS NOT NULL) AS word_boundary, count(*) AS n FROM k GROUP BY key),
  a AS (SELECT key, term_id, place, {trim_sql('alias')} AS alias FROM (SELECT key, term_id, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS place FROM k)),
  o AS (SELECT key, arg_min(alias, (term_id, place)) AS alias, min((term_id, place)) AS pos FROM a WHERE alias <> '' GROUP BY key, lower(alias)),
  l AS (SELECT o.key, string_agg(alias, ',' ORDER BY pos) AS aliases FROM o JOIN h USING (key) WHERE alias <> term GROUP BY o.key)
  SELECT term, slot, score, word_boundary, coalesce(aliases, '') AS aliases, CAST(n AS BIGINT) AS n_rows FROM h LEFT JOIN l USING (key)""")
def term_merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.merged_terms(table(spark, sf_dir, "ac_terms"), order="term_id").select("term", "slot", "score", "word_boundary", F.array_join("aliases", ",").alias("aliases"), "n_rows")


@register("""SELECT s_name AS term, 'device' AS domain, CAST(s_suppkey AS VARCHAR) AS entity_id, 0.99e0 AS score FROM supplier WHERE s_name IS NOT NULL
  UNION ALL SELECT '10.' || (s_suppkey % 300) || '.0.1', 'device', CAST(s_suppkey AS VARCHAR), 0.995e0 FROM supplier WHERE s_suppkey % 300 < 256
  UNION ALL SELECT n_name, 'region', CAST(n_nationkey AS VARCHAR), 0.99e0 FROM nation""")
def device_region_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows of assets; addresses that are no IPv4 give no row."""
    devices = table(spark, sf_dir, "supplier").withColumn("ip", F.concat(F.lit("10."), F.col("s_suppkey") % 300, F.lit(".0.1")))
    a = dictionary.asset_terms(devices, "device", "device_id", ["s_suppkey"], ["s_name"], "ip")
    b = dictionary.asset_terms(table(spark, sf_dir, "nation"), "region", "region_id", ["n_nationkey"], ["n_name"])
    return a.unionByName(b).select("term", "domain", "entity_id", "score")

QUERIES, SQL = register.queries, register.sql

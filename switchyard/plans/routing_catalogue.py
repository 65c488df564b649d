"""Queries of overrides, guards, gates, options and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import ranking, routing
from switchyard.plans.data_catalogue import _H5, _hits, _order_slots
from switchyard.plans.registry import Register
from switchyard.plans.text_catalogue import _DOCS, _FUSED, _GUARD, _POLICY, _SPELL, GOLDEN, _matches, documents, fused_scores, guard, policy
from switchyard.session import table

register = Register()
FLOWS = ["query", "report", "direct", "unknown", "analysis"]


@register(f"SELECT id, CASE WHEN lower(trim(context.flow_type)) IN ('query','report','direct','unknown','analysis') THEN lower(trim(context.flow_type)) WHEN lower(trim(role)) = 'direct' THEN 'direct' END AS flow FROM {GOLDEN}")
def flow_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, GOLDEN).select("id", routing.override_chain(FLOWS, F.col("context.flow_type"), F.col("role")).alias("flow"))


@register("""SELECT intent_id, CASE WHEN route_type IN ('query', 'report', 'direct') THEN route_type WHEN contains(route_type, 'report') OR (contains(route_type, 'task') AND contains(route_type, 'gen')) THEN 'report'
  WHEN contains(route_type, 'sql') OR contains(route_type, 'template') THEN 'query' ELSE 'unknown' END AS flow FROM capability_intents""")
def flow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [([["report"], ["task", "gen"]], "report"), ([["sql"], ["template"]], "query")]
    return table(spark, sf_dir, "capability_intents").select("intent_id", routing.label_by_words(F.col("route_type"), ["query", "report", "direct"], rules, "unknown").alias("flow"))


@register(f"""WITH {_H5}, n AS (SELECT query_id, count(*) FILTER (score >= 0.25) AS n, max(score) AS top FROM h GROUP BY 1)
  SELECT vec_id, CASE WHEN label % 2 = 0 AND (coalesce(n, 0) < 2 OR coalesce(top, 0) < 0.35) THEN 'out_of_seed_scope' END AS reason FROM embeddings LEFT JOIN n ON vec_id = query_id WHERE vec_id % 100 = 0""")
def seed_scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refuses queries (of even labels) with too few or too weak neighbours."""
    per = _hits(spark, sf_dir, 5).groupBy("query_id").agg(F.count(F.when(F.col("score") >= 0.25, 1)).alias("n"), F.max("score").alias("top"))
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "label")
    joined = asked.join(per, asked.vec_id == per.query_id, "left")
    return joined.select("vec_id", routing.support_guard(F.col("label") % 2 == 0, F.col("n"), F.col("top"), 2, 0.35, "out_of_seed_scope").alias("reason"))


@register(f"""{_FUSED}, b AS (SELECT doc_id, source, scene, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS rn FROM fs) WHERE rn = 1)
  SELECT doc_id, CASE WHEN scene IN ('en', 'de') AND score >= 0.4 THEN CASE WHEN source IS NULL THEN 'clarify:source' ELSE 'route:' || scene END WHEN scene NOT IN ('en', 'de') THEN 'route_report' ELSE 'continue' END AS decision FROM b""")
def template_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.best_per_key(fused_scores(spark, sf_dir), ["doc_id"], [F.round("score", 9).desc(), F.col("ord")])
    flow = F.when(F.col("scene").isin("en", "de"), "query").otherwise("report")
    lacking = F.when(F.col("source").isNull(), F.array(F.lit("source"))).otherwise(F.array().cast("array<string>"))
    decision = F.coalesce(routing.flow_gate(flow), routing.template_gate(flow, F.col("scene"), F.col("score"), lacking, 0.4), F.lit("continue"))
    return best.select("doc_id", decision.alias("decision"))


@register(f"""{_DOCS}, s AS (SELECT doc_id, {_GUARD} AS g, {_POLICY} AS p FROM d)
  SELECT doc_id, 'normalize:continue>guard:' || coalesce(g, 'continue') || CASE WHEN g IS NULL THEN '>policy:' || coalesce(p, 'continue') || CASE WHEN p IS NULL THEN '>route:route' ELSE '' END ELSE '' END AS trace FROM s""")
def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = guard(documents(spark, sf_dir)).withColumnRenamed("_d", "g")
    d = policy(d).withColumnRenamed("_d", "p")
    steps = routing.trace(("normalize", F.lit(None).cast("string"), None), ("guard", F.col("g"), None), ("policy", F.col("p"), None), ("route", F.lit("route"), F.lit(1.0)))
    return d.select("doc_id", routing.rendered_trace(steps).alias("trace"))


@register(f"""{_SPELL}, cand AS (SELECT id, slot, coalesce(nullif(entity_name, ''), entity_id) AS label, row_number() OVER (PARTITION BY id, slot ORDER BY score DESC, first, last, folded, domain, entity_id) AS rn FROM m)
  SELECT id, slot, string_agg(label, '|' ORDER BY rn) AS options FROM cand WHERE rn <= 3 GROUP BY 1, 2""")
def slot_candidate_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three candidates per slot as options."""
    order = [F.col("score").desc(), "first", "last", "folded", "domain", "entity_id"]
    best = ranking.top_k(_matches(spark, sf_dir), ["id", "slot"], [F.col(o) if isinstance(o, str) else o for o in order], 3)
    lists = best.groupBy("id", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("entity_name").alias("name"), "entity_id"))).alias("c"))
    return lists.select("id", "slot", F.array_join(routing.candidate_options(F.col("c")), "|").alias("options"))


_OPTIONS = {"out_of_seed_scope": ["t1", "t2", "a1"], "permission_denied": ["t1", "a1", "a2"], "unknown_domain": ["capability.list", "t1", "t2", "t3"]}


@register(f"""SELECT id, CASE expected.out_of_scope_reason WHEN 'out_of_seed_scope' THEN 't1,t2,a1' WHEN 'permission_denied' THEN 't1,a1,a2' WHEN 'unknown_domain' THEN 'capability.list,t1,t2,t3' ELSE 't1,a1,capability.list' END AS options FROM {GOLDEN}""")
def refuse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options by reason: templates, then actions, once each and at most four."""
    arr = lambda names: F.array(*map(F.lit, names))
    options = routing.reason_options(F.col("expected.out_of_scope_reason"), {k: [arr(v), arr(v[:1])] for k, v in _OPTIONS.items()}, [arr(["t1", "a1"]), arr(["a1", "capability.list"])])
    return table(spark, sf_dir, GOLDEN).select("id", F.array_join(options, ",").alias("options"))


@register("SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice >= 50000 AS failed FROM orders")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a lookup failed and nothing else is known."""
    error = F.when(F.col("o_orderstatus") == "F", "timeout")
    return _order_slots(spark, sf_dir).select("o_orderkey", routing.lookup_failed(error, F.lit(0), F.try_element_at("slots", F.lit("size"))).alias("failed"))


@register(f"""SELECT id, coalesce(expected.type, '') || '/' || coalesce(expected.scene, '') || '/' || coalesce(expected.template_id, '') AS label,
  CASE WHEN expected.type IN ('route_template', 'route_nl2sql') THEN 1.2e0 WHEN expected.type = 'refuse' THEN 1.1e0 ELSE 1.0e0 END AS weight FROM {GOLDEN}""")
def benchmark_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("expected")
    label = F.concat_ws("/", *(F.coalesce(e[c], F.lit("")) for c in ("type", "scene", "template_id")))
    return table(spark, sf_dir, GOLDEN).select("id", label.alias("label"), routing.case_weight(e["type"], {"route_template": 1.2, "route_nl2sql": 1.2, "refuse": 1.1}).alias("weight"))


QUERIES, SQL = register.queries, register.sql

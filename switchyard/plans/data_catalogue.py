"""Queries of retrieval, ranking, slots, batch import, compilation, evaluation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import scoring, text
from switchyard.operators import evaluate, ranking, retrieve, seeds, slots
from switchyard.plans import compiler
from switchyard.plans.registry import Register
from switchyard.plans.text_catalogue import _GAPS, _GUARD, _POLICY, _ROUTED, GOLDEN, guard, norm_sql, policy, routed, scope_gaps, tokens_sql
from switchyard.session import is_small, materialize, shared_folder, spread, table
from switchyard.streaming import windows

register = Register()
big = lambda c: F.col(c).cast("bigint").alias(c)

# ---------------------------------------------------------------- retrieval


def _hits(spark: SparkSession, sf_dir: str, k: int, same: str | None = None) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieve.knn(vectors.where("vec_id % 100 = 0"), vectors, k, "vec_id", "vec_id", "embedding", same).toDF("query_id", "item_id", "score", "rank")


def _hits_sql(name: str, k: int, extra: str = "") -> str:
    return f"""{name} AS (SELECT query_id, item_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {extra} WHERE a.vec_id % 100 = 0) WHERE rank <= {k})"""


_H5, _H5L = _hits_sql("h", 5), _hits_sql("hl", 5, "AND a.label = b.label")


@register(f"WITH {_H5} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM h")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5).select("query_id", "item_id", F.round("score", 6).alias("score"), big("rank"))


@register(f"WITH {_H5L} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM hl")
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 5, "label").select("query_id", "item_id", F.round("score", 6).alias("score"), big("rank"))


@register(f"WITH {_H5} SELECT query_id, label, round(max(s), 6) AS score FROM (SELECT query_id, item_id, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS s FROM h) JOIN embeddings ON vec_id = item_id GROUP BY 1, 2")
def vector_map_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits divided by their query's best, then the best per label."""
    hits = ranking.max_normalise(_hits(spark, sf_dir, 5), ["query_id"], "score", "s")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return hits.join(labels, "item_id").groupBy("query_id", "label").agg(F.round(F.max("s"), 6).alias("score"))


def _text_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """BM25 of every document whose id is divisible by 100, with its whole text as the query, against all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return retrieve.bm25(docs.where("doc_id % 100 = 0"), docs, "doc_id", "text", "doc_id", "text", k)


_BM25 = f"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{text.TOKEN_SPLIT}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM w), ix AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM e GROUP BY 1, 2),
  st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), df AS (SELECT token, count(*) AS df FROM ix GROUP BY 1),
  q AS (SELECT doc_id AS query_id, unnest({tokens_sql('text')}) AS token FROM documents WHERE doc_id % 100 = 0),
  sc AS (SELECT query_id, ix.doc_id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM q JOIN df USING (token) JOIN ix USING (token) CROSS JOIN st GROUP BY 1, 2),
  th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= @)"""


@register(f"WITH {_BM25.replace('@', '10')} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM th")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_hits(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), big("rank"))


@register(f"""WITH {_BM25.replace('@', '10')}, {_hits_sql('h', 20)},
  v AS (SELECT query_id, item_id, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS s FROM h),
  t AS (SELECT query_id, doc_id AS item_id, score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS s FROM th)
  SELECT query_id, item_id, round(0.7e0 * coalesce(v.s, 0) + 0.3e0 * coalesce(t.s, 0), 4) AS score FROM v FULL JOIN t USING (query_id, item_id)""")
def hybrid_fusion_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _text_hits(spark, sf_dir, 10).select("query_id", F.col("doc_id").alias("item_id"), "score")
    return ranking.fuse(_hits(spark, sf_dir, 20), texts, "query_id", "item_id").select("query_id", "item_id", F.round("score", 4).alias("score"))


@register(f"WITH {_H5}, p AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM h GROUP BY 1) SELECT query_id, a >= 0.3 AND a - coalesce(b, 0) >= 0.02 AS committed FROM p")
def commit_gate_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_gap(_hits(spark, sf_dir, 5), ["query_id"], "item_id", "score", "item_id")
    return best.select("query_id", ranking.commit(F.col("top1_score"), F.col("top2_score"), 0.3, 0.02).alias("committed"))


@register(f"WITH {_H5}, {_H5L}, u AS (SELECT query_id, item_id, score FROM h UNION ALL SELECT query_id, item_id, score FROM hl) SELECT query_id, item_id, round(max(score), 6) AS score FROM u GROUP BY 1, 2")
def candidate_merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _hits(spark, sf_dir, 5).unionByName(_hits(spark, sf_dir, 5, "label"))
    best = ranking.best_per_key(both, ["query_id", "item_id"], [F.col("score").desc(), F.col("rank")])
    return best.select("query_id", "item_id", F.round("score", 6).alias("score"))


@register("""SELECT n_name, s_suppkey, round(s, 6) AS score FROM (SELECT n_name, s_suppkey, s_acctbal / coalesce(nullif(max(s_acctbal) OVER (PARTITION BY n_name), 0), 1) AS s,
  row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rn <= 3""")
def resolver_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per nation, scores divided by the best."""
    nations = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nations) if is_small(nations) else nations, F.col("s_nationkey") == F.col("n_nationkey"))
    best = ranking.top_k(s, ["n_name"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3)
    return ranking.max_normalise(best, ["n_name"], "s_acctbal", "s").select("n_name", "s_suppkey", F.round("s", 6).alias("score"))


@register("SELECT capability_id, label, CAST(rn AS BIGINT) AS rank FROM (SELECT capability_id, label, row_number() OVER (PARTITION BY capability_id ORDER BY o, label) AS rn FROM (SELECT capability_id, coalesce(label, '') AS label, min(intent_id) AS o FROM capability_intents GROUP BY 1, 2)) WHERE rn <= 4")
def option_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four distinct labels of each capability, in order."""
    t = table(spark, sf_dir, "capability_intents").select("capability_id", F.coalesce("label", F.lit("")).alias("label"), F.col("intent_id").alias("o"))
    return ranking.distinct_in_order(t, ["capability_id"], ["label"], "o", 4).select("capability_id", "label", big("rank"))


# ---------------------------------------------------------------- slots


def _order_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    base = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    new = F.create_map(F.lit("priority"), F.when(F.col("o_totalprice") > 200000, "0-VIP").otherwise(""), F.lit("size"), F.when(F.col("o_totalprice") < 50000, "small"))
    return o.select("o_orderkey", "o_totalprice", "o_orderstatus", slots.overlay(base, new).alias("slots"))


_SLOTS = "WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 200000 THEN '0-VIP' ELSE o_orderpriority END AS priority, CASE WHEN o_totalprice < 50000 THEN 'small' END AS size FROM orders)"


@register(f"{_SLOTS} SELECT o_orderkey, 'priority=' || priority || CASE WHEN size IS NOT NULL THEN ',size=' || size ELSE '' END || ',status=' || o_orderstatus AS slots FROM s")
def slot_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_slots(spark, sf_dir).select("o_orderkey", slots.sorted_text(F.col("slots")).alias("slots"))


@register(f"{_SLOTS} SELECT o_orderkey, 'region=EU,' || 'size=' || coalesce(size, 'medium') AS slots FROM s")
def slot_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = F.create_map(F.lit("size"), F.lit("medium"), F.lit("region"), F.lit("EU"))
    full = slots.with_defaults(F.col("slots"), defaults)
    return _order_slots(spark, sf_dir).select("o_orderkey", slots.sorted_text(F.map_filter(full, lambda k, v: k.isin("size", "region"))).alias("slots"))


_COND = [("status", "F", ["closed_at", "priority"]), ("size", "small", ["bundle"])]


@register(f"{_SLOTS} SELECT o_orderkey, 'priority' || CASE WHEN o_orderstatus = 'F' THEN ',closed_at' ELSE '' END || CASE WHEN size = 'small' THEN ',bundle' ELSE '' END AS required FROM s")
def conditional_required_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = slots.required_slots(F.array(F.lit("priority")), _COND, F.col("slots"))
    return _order_slots(spark, sf_dir).select("o_orderkey", F.array_join(need, ",").alias("required"))


@register(f"""{_SLOTS} SELECT o_orderkey, (2.0e0 + CASE WHEN size IS NULL THEN 0 ELSE 1 END) / 4 AS coverage, round(0.8e0 * (1.0e0 + CASE WHEN size IS NULL THEN 0 ELSE 1 END) / 2 + 0.2e0 * 0.5e0, 6) AS fit FROM s""")
def entity_coverage_slot_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *n: F.array(*map(F.lit, n))
    s = F.col("slots")
    return _order_slots(spark, sf_dir).select("o_orderkey", scoring.coverage(s, names("status", "priority", "size", "colour")).alias("coverage"), F.round(scoring.slot_fit(s, names("priority", "size"), names("status", "colour")), 6).alias("fit"))


@register(f"""{_SLOTS}, r AS (SELECT o_orderkey, unnest([{{'slot': 'time', 'base': 0.9e0, 'ord': 0, 'fits': true, 'x': -0.12e0}}, {{'slot': 'device', 'base': 0.75e0, 'ord': 1, 'fits': size IS NOT NULL, 'x': 0.31e0}},
  {{'slot': 'metric', 'base': 0.8e0, 'ord': 2, 'fits': true, 'x': -0.06e0}}]) AS u FROM s),
  k AS (SELECT o_orderkey, u.slot AS slot, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN u.fits THEN u.base + u.x ELSE u.base - 100 END DESC, u.ord) AS rn FROM r)
  SELECT o_orderkey, string_agg(slot, ',' ORDER BY rn) AS ask FROM k WHERE rn <= 2 GROUP BY 1""")
def slot_policy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two slots most worth asking for, by policy: a condition on another slot, inference, default and cost."""
    held = slots.applies(F.create_map(F.lit("size"), F.array(F.lit("small"))), F.col("slots"))
    yes, no = F.lit(True), F.lit(False)
    policy = [("time", 0.9, yes, no, yes, 0.1), ("device", slots.policy_value(F.lit(None).cast("double"), F.lit(0.75), F.lit(0.5)), held, yes, no, 0.45), ("metric", 0.8, yes, no, no, 0.3)]
    ranked = F.array(*(F.struct(slots.ask_score(b if not isinstance(b, float) else F.lit(b), fits, infer, default, F.lit(cost)).alias("score"), F.lit(i).alias("ord"), F.lit(s).alias("slot")) for i, (s, b, fits, infer, default, cost) in enumerate(policy)))
    return _order_slots(spark, sf_dir).select("o_orderkey", F.array_join(slots.to_ask(ranked, 2), ",").alias("ask"))


_ROUND = "CASE WHEN TRY_CAST(context.clarify_round AS INTEGER) IS NULL THEN 0 ELSE greatest(0, TRY_CAST(context.clarify_round AS INTEGER)) END"


@register(f"SELECT id, CAST({_ROUND} AS BIGINT) AS round, CASE WHEN coalesce(len(expected.missing_slots), 0) = 0 THEN 'complete' WHEN {_ROUND} >= 2 THEN 'exhausted' ELSE 'ask' END AS step FROM {GOLDEN}")
def clarify_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's round counter, coerced, and what a request with missing slots does next."""
    g = table(spark, sf_dir, GOLDEN).withColumn("round", text.round_count(F.col("context.clarify_round"), 0, 0))
    n = F.coalesce(F.array_size("expected.missing_slots"), F.lit(0))
    return g.select("id", big("round"), slots.clarify_step(n, F.col("round"), F.lit(2)).alias("step"))


# ---------------------------------------------------------------- batch import


def _seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.normalized_rows(spread(table(spark, sf_dir, "seed_cases_template").select("row_id", *seeds.REQUIRED, *seeds.DEFAULTS, "slots_json", "tags", "enabled", "priority")), "row_id")


def _clean(c: str) -> str:
    return f"coalesce(regexp_replace(CAST({c} AS VARCHAR), '^{text.SPACE}+|{text.SPACE}+$', '', 'g'), '')"


def _trim(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '^{text.SPACE}+|{text.SPACE}+$', '', 'g')"


_SEEDS = f"""WITH n AS (SELECT row_id, {_clean('case_id')} AS case_id, {_clean('scene_id')} AS scene_id, {_clean('label')} AS label, {_clean('text')} AS text, coalesce(priority, 100) AS priority, {_clean('slots_json')} AS slots, coalesce({_trim('version')}, 'v1') AS version,
    coalesce(enabled, true) AS enabled, coalesce({_trim('owner')}, '') AS owner, coalesce({_trim('risk_level')}, 'medium') AS risk_level, coalesce({_trim('source')}, 'import') AS source, coalesce({_trim('notes')}, '') AS notes, coalesce({_trim('route_type')}, 'route_nl2sql') AS route_type FROM seed_cases_template),
  s AS (SELECT *, CASE WHEN case_id = '' THEN 'missing_case_id' WHEN scene_id = '' THEN 'missing_scene_id' WHEN label = '' THEN 'missing_label' WHEN text = '' THEN 'missing_text'
    WHEN length(text) < 2 THEN 'short_text' WHEN slots <> '' AND NOT (json_valid(slots) AND json_type(slots) = 'OBJECT') THEN 'bad_slots' END AS reason FROM n)"""


@register(f"{_SEEDS} SELECT row_id, case_id, enabled, CAST(priority AS BIGINT) AS priority, owner, version, risk_level, source, notes, route_type, reason FROM s")
def seed_import_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seed_rows(spark, sf_dir).select("row_id", "case_id", "enabled", big("priority"), "owner", "version", "risk_level", "source", "notes", "route_type", "reason")


@register(f"""WITH raw AS (SELECT * FROM seed_cases_template WHERE slots_json IS NOT NULL AND trim(slots_json) <> ''), spoilt AS (
    SELECT row_id, unnest([{{'how': 'trailing', 'ok': false}}, {{'how': 'array', 'ok': false}}, {{'how': 'escaped', 'ok': true}}, {{'how': 'quoted', 'ok': true}}, {{'how': 'word', 'ok': false}}]) AS x FROM raw)
  SELECT row_id, x.how AS how, CASE WHEN x.ok THEN NULL WHEN x.how = 'word' THEN 'bad_enabled' ELSE 'bad_slots' END AS reason FROM spoilt JOIN ({_SEEDS} SELECT row_id FROM s WHERE reason IS NULL) v USING (row_id)""")
def seed_import_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows spoilt in known ways: text after the object, an array, escaped quotes, an object in quotes, an unknown word for enabled."""
    ok = _seed_rows(spark, sf_dir).where("reason is null").select("row_id")
    rows = table(spark, sf_dir, "seed_cases_template").where(F.trim("slots_json") != "").join(ok, "row_id")
    j, on = F.col("slots_json"), F.col("enabled").cast("string")
    ways = {"trailing": (F.concat(j, F.lit(" {}")), on), "array": (F.concat(F.lit("["), j, F.lit("]")), on), "escaped": (F.lit('{\\"a\\": 1}'), on), "quoted": (F.lit("'{\"a\": 1}'"), on), "word": (j, F.lit("maybe"))}
    spoilt = F.inline(F.array(*(F.struct(F.lit(w).alias("how"), a.alias("slots_json"), b.alias("enabled")) for w, (a, b) in ways.items())))
    each = rows.select("row_id", *seeds.REQUIRED, "tags", "priority", spoilt).withColumn("at", F.struct("row_id", "how"))
    return seeds.normalized_rows(each, "at").select("at.row_id", "at.how", "reason")


@register(f"""{_SEEDS}, k AS (SELECT case_id, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok FROM s GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS rows_total, CAST(count(*) FILTER (ok > 0) AS BIGINT) AS rows_ok, CAST(sum(n - ok) AS BIGINT) AS rows_invalid, CAST(sum(ok) - count(*) FILTER (ok > 0) AS BIGINT) AS duplicates, CAST(count(*) FILTER (ok > 0) AS BIGINT) AS output_count FROM k""")
def seed_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.import_counts(_seed_rows(spark, sf_dir), "case_id")


def _keep(policy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = _seed_rows(spark, sf_dir).where("reason is null").select("case_id", "row_id")
    return seeds.one_per_key(ok, "case_id", "row_id", policy).select("case_id", "row_id", "position", "n_rows")


def _keep_sql(direction: str) -> str:
    return f"""{_SEEDS} SELECT case_id, row_id, position, n_rows FROM (SELECT case_id, row_id, min(row_id) OVER (PARTITION BY case_id) AS position, CAST(count(*) OVER (PARTITION BY case_id) AS BIGINT) AS n_rows,
      row_number() OVER (PARTITION BY case_id ORDER BY row_id {direction}) AS rn FROM s WHERE reason IS NULL) WHERE rn = 1"""


@register(_keep_sql("ASC"))
def seed_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep("keep_first", spark, sf_dir)


@register(_keep_sql("DESC"))
def seed_dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep("keep_last", spark, sf_dir)


@register(f"""{_SEEDS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version, case_id ORDER BY row_id DESC) AS rn FROM s WHERE reason IS NULL AND version IN ('v1', 'v2')) WHERE rn = 1),
  a AS (SELECT case_id, row_id FROM o WHERE version = 'v1'), b AS (SELECT case_id, row_id FROM o WHERE version = 'v2')
  SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.row_id, a.row_id) AS row_id, CASE WHEN b.row_id IS NULL THEN 'kept' WHEN a.row_id IS NULL THEN 'added' ELSE 'replaced' END AS origin FROM a FULL JOIN b USING (case_id)""")
def seed_upsert_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version v2 rows written over those of v1, one per case."""
    ok = materialize(_seed_rows(spark, sf_dir).where("reason is null").select("case_id", "row_id", "version"))  # read by both sides
    one = lambda v: seeds.one_per_key(ok.where(F.col("version") == v).drop("version"), "case_id", "row_id").select("case_id", "row_id")
    return seeds.upsert(one("v1"), one("v2"), "case_id")


@register(f"""{_SEEDS}, o AS (SELECT case_id, version, max(row_id) AS row_id FROM s WHERE reason IS NULL AND version IN ('v1', 'v2') GROUP BY 1, 2),
  a AS (SELECT * FROM o WHERE version = 'v1'), b AS (SELECT * FROM o WHERE version = 'v2')
  SELECT 'replace' AS mode, case_id, row_id, CAST(row_number() OVER (ORDER BY case_id) AS BIGINT) AS place FROM b
  UNION ALL SELECT 'upsert', case_id, row_id, row_number() OVER (ORDER BY case_id) FROM (SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.row_id, a.row_id) AS row_id FROM a FULL JOIN b USING (case_id))""")
def seed_merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes of merging, with the place of each row in the order of its id."""
    ok = materialize(_seed_rows(spark, sf_dir).where("reason is null").select("case_id", "row_id", "version"))  # read by both sides
    one = lambda v: seeds.one_per_key(ok.where(F.col("version") == v).drop("version"), "case_id", "row_id").select("case_id", "row_id")
    placed = [ranking.with_places(seeds.merged(one("v1"), one("v2"), "case_id", m), "case_id").select(F.lit(m).alias("mode"), "case_id", "row_id", "place") for m in ("replace", "upsert")]
    return placed[0].unionByName(placed[1])


@register("SELECT row_id, scene_id FROM seed_cases_template WHERE scene_id IS NOT NULL AND scene_id NOT IN (SELECT capability_id FROM capabilities WHERE capability_id IS NOT NULL)")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.missing_keys(table(spark, sf_dir, "seed_cases_template"), table(spark, sf_dir, "capabilities"), "scene_id", "capability_id").select("row_id", "scene_id")


@register("SELECT DISTINCT scene_id AS capability_id FROM seed_cases_template WHERE scene_id IS NULL OR scene_id NOT IN (SELECT capability_id FROM capability_intents WHERE capability_id IS NOT NULL)")
def legacy_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of seeds that no intent lists."""
    legacy = table(spark, sf_dir, "seed_cases_template").select(F.col("scene_id").alias("capability_id")).distinct()
    return seeds.not_yet_listed(legacy, table(spark, sf_dir, "capability_intents"), "capability_id")


@register("""WITH l AS (SELECT capability_id, array_to_string(list_sort(list(intent_id)), ',') AS c FROM capability_intents GROUP BY 1)
  SELECT capability_id, version, created_at, coalesce(c, '') AS children FROM capabilities LEFT JOIN l USING (capability_id)""")
def group_collect_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = seeds.grouped_back(table(spark, sf_dir, "capabilities"), table(spark, sf_dir, "capability_intents"), "capability_id", "intent_id")
    return back.select("capability_id", "version", "created_at", F.array_join("children", ",").alias("children"))


# ---------------------------------------------------------------- compilation


@register("""WITH s AS (SELECT capability_id, version, list_concat([coalesce(description, '')], coalesce(entry_phrases, []), coalesce(keywords, [])) AS t FROM capabilities WHERE coalesce(enabled, true)),
  e AS (SELECT capability_id, version, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS place FROM s) SELECT capability_id || '_' || place AS doc_id, capability_id AS scene_id, version, text FROM e WHERE text <> ''""")
def explode_index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.index_documents(compiler.scenes(table(spark, sf_dir, "capabilities")))


@register(f"""WITH s AS (SELECT capability_id, list_concat([coalesce(description, '')], coalesce(entry_phrases, []), coalesce(keywords, [])) AS t FROM capabilities WHERE coalesce(enabled, true)),
  e AS (SELECT capability_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS place FROM s),
  i AS (SELECT {_clean('case_id')} AS doc_id, capability_id AS scene_id, template_id, coalesce(nullif({_clean('text')}, ''), nullif({_clean('label')}, ''), nullif({_clean('case_id')}, '')) AS text FROM capability_intents WHERE coalesce(enabled, true))
  SELECT 'scene' AS kind, capability_id || '_' || place AS doc_id, capability_id AS scene_id, CAST(NULL AS VARCHAR) AS template_id, text FROM e WHERE text <> ''
  UNION ALL SELECT 'seed', * FROM i WHERE doc_id <> ''""")
def index_docs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of scenes, templates and seeds. The test tables name templates without examples or keywords, so none of these has a document."""
    intents = table(spark, sf_dir, "capability_intents")
    return compiler.all_index_documents(compiler.scenes(table(spark, sf_dir, "capabilities")), compiler.templates(intents), compiler.seeds(intents))


@register(f"""SELECT {_clean('template_id')} AS template_id, capability_id AS scene_id, {_clean('case_id')} AS case_id_ref FROM capability_intents
  WHERE coalesce(enabled, true) AND {_clean('template_id')} <> '' AND {_clean('case_id')} <> ''""")
def compile_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.templates(table(spark, sf_dir, "capability_intents")).select("template_id", "scene_id", "case_id_ref")


@register(f"""SELECT intent_id, capability_id AS scene_id, coalesce(nullif({_clean('text')}, ''), nullif({_clean('label')}, ''), nullif({_clean('case_id')}, '')) AS text,
  coalesce(nullif({_clean('route_type')}, ''), CASE WHEN template_id IS NULL THEN 'route_nl2sql' ELSE 'route_template' END) AS route_type, CAST(coalesce(priority, 100) AS BIGINT) AS priority FROM capability_intents WHERE coalesce(enabled, true)""")
def compile_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.seeds(table(spark, sf_dir, "capability_intents")).select("intent_id", "scene_id", "text", "route_type", big("priority"))


@register("""SELECT 'capability_unique' AS rule, capability_id AS key, CAST(count(*) AS BIGINT) AS n FROM capabilities GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'priority_range', capability_id, count(*) FROM capabilities WHERE router_priority < 50 OR router_priority > 95 GROUP BY 2
  UNION ALL SELECT 'score_range', term_id, count(*) FROM ac_terms WHERE score < 0.6 OR score > 0.95 GROUP BY 2
  UNION ALL SELECT 'intent_scene', intent_id, count(*) FROM capability_intents WHERE capability_id IS NOT NULL AND capability_id NOT IN (SELECT capability_id FROM capabilities) GROUP BY 2""")
def config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of the configuration tables: unique keys, ranges and foreign keys."""
    caps, terms = table(spark, sf_dir, "capabilities"), table(spark, sf_dir, "ac_terms")
    lost = seeds.missing_keys(table(spark, sf_dir, "capability_intents"), caps, "capability_id", "capability_id")
    return compiler.all_violations(
        compiler.violations("capability_unique", caps, F.col("capability_id"), unique=True), compiler.violations("priority_range", caps, F.col("capability_id"), bad=(F.col("router_priority") < 50) | (F.col("router_priority") > 95)),
        compiler.violations("score_range", terms, F.col("term_id"), bad=(F.col("score") < 0.6) | (F.col("score") > 0.95)), compiler.violations("intent_scene", lost, F.col("intent_id")),
    )


# ---------------------------------------------------------------- evaluation


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language scene of each document against its language, weighted by source."""
    r = scope_gaps(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    weight = F.when(F.col("source") == "wiki_runbook", 1.2).when(F.col("source") == "alarm_feed", 1.1).otherwise(1.0)
    return r.withColumn("ok", evaluate.matches({"scene": F.col("lang")}, {"scene": F.col("top1")})).withColumn("weight", weight)


_RESULTS = f"""{_GAPS}, res AS (SELECT d.doc_id, d.lang, d.source, gate.decision, gate.s1, coalesce(d.lang IS NULL OR d.lang = gate.top1, false) AS ok,
  CASE d.source WHEN 'wiki_runbook' THEN 1.2e0 WHEN 'alarm_feed' THEN 1.1e0 ELSE 1.0e0 END AS weight FROM gate JOIN d USING (doc_id))"""


@register(f"""{_RESULTS} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS passed, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed,
  round(sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight), 6) AS weighted_accuracy, round(avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END), 6) AS exact_accuracy FROM res""")
def evaluate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_results(spark, sf_dir))


@register(f"{_RESULTS} SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS passed, round(avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM res GROUP BY lang")
def per_type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_by(_results(spark, sf_dir), ["lang"])


@register(f"""{_ROUTED}, u AS (SELECT doc_id, decision, scene FROM routed UNION ALL SELECT doc_id, decision, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE scene END FROM routed UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'refuse:other' ELSE decision END, scene FROM routed),
  p AS (SELECT doc_id, count(DISTINCT coalesce(decision, '') || '|' || coalesce(scene, '')) AS n FROM u GROUP BY 1)
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (n = 1) AS BIGINT) AS stable, round(avg(CASE WHEN n = 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS stability FROM p""")
def evaluate_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the flagship, two of which were made to differ for some documents, and the share of documents that agree."""
    runs = routed(spark, sf_dir).select("doc_id", "decision", "scene")
    second = runs.withColumn("scene", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("scene")))
    third = runs.withColumn("decision", F.when(F.col("doc_id") % 5 == 0, "refuse:other").otherwise(F.col("decision")))
    return evaluate.stability(runs.unionByName(second).unionByName(third), "doc_id", ["decision", "scene"])


@register(f"{_RESULTS} SELECT decision, lang, CAST(count(*) AS BIGINT) AS n, round(avg(s1), 6) AS mean_value, round(quantile_disc(s1, 0.95), 6) AS p95 FROM res GROUP BY GROUPING SETS ((decision), (lang), ())")
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.decision_metrics(_results(spark, sf_dir), ["decision", "lang"], "top1_score")


@register(f"""WITH g AS (SELECT id, expected, text, {norm_sql('text')} AS norm FROM {GOLDEN}), a AS (SELECT id, CASE WHEN {_GUARD} IS NOT NULL THEN split_part({_GUARD}, ':', 1) WHEN {_POLICY} IS NOT NULL THEN 'refuse' ELSE 'route_nl2sql' END AS type,
    CASE WHEN contains(norm, '近') THEN ['device_id'] ELSE ['time_range', 'device_id', 'region_id'] END AS missing FROM g),
  j AS (SELECT g.id, g.expected.type IS NOT NULL AND g.expected.type <> a.type AS t, len(list_filter(coalesce(g.expected.missing_slots, []), lambda x: NOT list_contains(a.missing, x))) > 0 AS m FROM g JOIN a USING (id))
  SELECT id, NOT t AND NOT m AS ok, concat_ws(',', CASE WHEN t THEN 'type' END, CASE WHEN m THEN 'missing_slots' END) AS differs FROM j""")
def expected_actual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual by case id: equal type, and the missing slots expected among those reported."""
    cases = table(spark, sf_dir, GOLDEN).withColumn("norm", text.normalize_text(F.col("text")))
    decided = ranking.first_decision(cases, [guard, policy])
    names = lambda *x: F.array(*map(F.lit, x))
    missing = F.when(F.contains("norm", F.lit("近")), names("device_id")).otherwise(names("time_range", "device_id", "region_id"))
    actual = decided.select("id", F.coalesce(F.substring_index("decision", ":", 1), F.lit("route_nl2sql")).alias("type"), missing.alias("missing"))
    both = cases.select("id", "expected").join(actual, "id")
    e, subset = {"type": F.col("expected.type")}, (F.col("expected.missing_slots"), F.col("missing"))
    return both.select("id", evaluate.matches(e, {"type": F.col("type")}, subset).alias("ok"), evaluate.failure_reason(e, {"type": F.col("type")}, ("missing_slots", *subset)).alias("differs"))


# ---------------------------------------------------------------- streams


@register("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling_metrics(table(spark, sf_dir, "events"), "ts", "event_type", "value")


@register("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows as a stream over all that is available, in complete mode."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "events"))
    return windows.run_available(windows.tumbling_metrics(stream, "ts", "event_type", "value", late="3650 days"), _checkpoint(spark), "complete")


@register(f"SELECT id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS tokens FROM {GOLDEN} WHERE text IS NOT NULL")
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateless stage on a stream gives what it gives on a table."""
    schema = table(spark, sf_dir, GOLDEN).schema
    stream = spark.readStream.schema(schema).parquet(_folder(spark, sf_dir, GOLDEN)).where("text is not null")
    return windows.run_available(stream.select("id", F.array_join(F.array_sort(text.tokenize(F.col("text"))), " ").alias("tokens")), _checkpoint(spark))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A pattern that names the table's file or folder, as file streams read folders or patterns."""
    return f"{sf_dir}/{name}.parque[t]"


def _checkpoint(spark: SparkSession) -> str:
    """A fresh folder for a stream's progress, in the shared folder if one is named."""
    return f"{shared_folder(spark, 'stream')}/stream-{uuid.uuid4().hex}"


QUERIES, SQL = register.queries, register.sql

"""Queries that go through readers and sinks: tables are written in a format, or spoilt, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import scoring, text
from switchyard.operators import dictionary, retrieve, seeds
from switchyard.plans.registry import Register
from switchyard.plans.text_catalogue import GOLDEN
from switchyard.session import shared_folder, table
from switchyard.sources import readers, search, sinks

register = Register()


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines see."""
    return f"{shared_folder(spark, 'io')}/{name}-{uuid.uuid4().hex}"


def _local(folder: str, name: str) -> str:
    """A file in the folder for what the driver writes by itself."""
    return f"{folder.removeprefix('file://')}/{name}"


_COLUMNS = ("row_id", "case_id", "text", "tags", "slots_json")
_READ = "SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _COLUMNS[1:]) + " FROM seed_cases_template"


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _COLUMNS))


@register(_READ)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed cases as CSV and back; quotes, commas and line breaks in values stay."""
    path = _folder(spark, "csv") + ".csv"
    rows = _texts(table(spark, sf_dir, "seed_cases_template"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _texts(readers.read_rows(spark, path, ", ".join(f"{c} string" for c in _COLUMNS)))


@register(_READ)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed cases as one JSON text a row, and back through the schema."""
    path = _folder(spark, "json") + ".json"
    sinks.write_json_rows(_texts(table(spark, sf_dir, "seed_cases_template")), path)
    return _texts(spark.read.schema(", ".join(f"{c} string" for c in _COLUMNS)).json(path))


@register("""WITH n AS (SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'not_object' END AS reason FROM seed_cases_template)
  SELECT reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN reason IS NULL THEN row_id END) AS BIGINT) AS ids FROM n GROUP BY 1""")
def jsonl_with_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of objects among broken ones, arrays and blank lines; the sum of ids shows which were read."""
    path = _folder(spark, "lines") + ".jsonl"
    rows = table(spark, sf_dir, "seed_cases_template").select("row_id", F.to_json(F.struct("row_id", "text")).alias("j"))
    k = F.col("row_id") % 5
    line = F.when(k == 0, F.concat("j", F.lit(" x"))).when(k == 1, F.concat(F.lit("["), "j", F.lit("]"))).otherwise(F.concat("j", F.when(k == 2, "\n\n").otherwise("")))
    rows.select(line).write.text(path)
    got = readers.read_rows(spark, path, "row_id bigint, text string")
    return got.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.when(F.col("reason").isNull(), F.col("row_id"))).alias("ids"))


@register(f"SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS line_no FROM {GOLDEN}")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file with their numbers."""
    path = _folder(spark, "numbered")
    table(spark, sf_dir, GOLDEN).select("id").orderBy("id").coalesce(1).write.text(path)
    return readers.numbered_lines(spark, path).select(F.col("value").alias("id"), "line_no")


@register(f"""SELECT id, weight, coalesce(len(tags), 0) AS n_tags, CASE WHEN trim(id) = '' THEN 'id' WHEN trim(coalesce(text, '')) = '' THEN 'text' WHEN expected IS NULL THEN 'expected' END AS reason FROM (SELECT *, coalesce(weight, 1.0e0) AS weight FROM (SELECT id, text, expected, tags, weight FROM {GOLDEN}))""")
def benchmark_cases_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden set as a file of cases, read and checked."""
    path = _local(_folder(spark, "cases"), "cases.json")
    sinks.write_pretty(table(spark, sf_dir, GOLDEN).select("id", "text", "expected", "tags", "weight", "role", "tenant_id", "context"), path, ["id"], most=1_000_000)
    got = readers.benchmark_cases(spark, path)
    return got.select("id", "weight", F.greatest(F.coalesce(F.size("tags"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tags"), "reason")


@register("""WITH i AS (SELECT intent_id, text, intent_id % 3 AS k FROM (SELECT CAST(right(intent_id, 9) AS BIGINT) AS intent_id, coalesce(text, '') AS text FROM capability_intents))
  SELECT CAST(intent_id AS VARCHAR) AS id, CASE WHEN k = 2 THEN 'new ' || text ELSE text END AS text FROM i WHERE k > 0 UNION ALL SELECT 'extra' || intent_id, text FROM i WHERE k = 0""")
def index_bulk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of intents, of which a third is written over and a third added, in the parts these fall into alone."""
    path = _folder(spark, "index")
    docs = table(spark, sf_dir, "capability_intents").select(F.substring("intent_id", -9, 9).cast("bigint").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    vector = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    as_index = lambda df: df.select(F.col("id"), F.lit(None).cast("string").alias("scene_id"), F.lit(None).cast("string").alias("template_id"), "text", F.lit(None).cast("string").alias("metadata"), vector.alias("vector"))
    k = F.col("n") % 3
    sinks.bulk_upsert(spark, path, as_index(docs.where(k > 0).withColumn("id", F.col("n").cast("string"))), 2)
    more = docs.where(k != 1).select(F.when(k == 0, F.concat(F.lit("extra"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string")).alias("id"), F.when(k == 0, F.col("text")).otherwise(F.concat(F.lit("new "), "text")).alias("text"))
    return sinks.bulk_upsert(spark, path, as_index(more), 2).select("id", "text")


@register("""WITH t AS (SELECT trim(s_name) AS term FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT upper(trim(s_name)) FROM supplier)
  SELECT lower(term) AS term, CAST(count(*) AS BIGINT) AS n_rows FROM t GROUP BY 1""")
def terms_union_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated terms and those of an exported dictionary as one, the same term in other case being one."""
    path = _local(_folder(spark, "terms"), "terms.json")
    devices = table(spark, sf_dir, "supplier")
    new = dictionary.asset_terms(devices, "device", "device_id", ["s_suppkey"], ["s_name"]).withColumns({"term": F.upper("term"), "aliases": F.array().cast("array<string>"), "word_boundary": F.lit(None).cast("boolean")})
    old = dictionary.asset_terms(devices.where("s_suppkey % 2 = 0"), "device", "device_id", ["s_suppkey"], ["s_name"])
    sinks.write_pretty(old, path, ["term"])
    both = readers.existing_terms(spark, path).drop("metadata", "ord").unionByName(new.select("term", "domain", "slot", "value", "entity_id", "entity_name", "score", "aliases", "word_boundary"))
    return dictionary.in_order(dictionary.merged_terms(both)).select(F.lower("term").alias("term"), "n_rows")


@register("""WITH s AS (SELECT trim(case_id) AS case_id, scene_id, max(row_id) AS row_id FROM seed_cases_template WHERE trim(coalesce(case_id, '')) <> '' AND scene_id IS NOT NULL GROUP BY 1, 2),
  i AS (SELECT capability_id AS scene_id, trim(case_id) AS case_id, min(template_id) AS template_id FROM capability_intents WHERE trim(coalesce(template_id, '')) <> '' GROUP BY 1, 2),
  j AS (SELECT s.scene_id, s.case_id, template_id FROM s LEFT JOIN i ON s.scene_id = i.scene_id AND s.case_id = i.case_id)
  SELECT scene_id, CAST(count(*) AS BIGINT) AS n_seeds, CAST(count(template_id) AS BIGINT) AS n_templates FROM j GROUP BY 1""")
def write_back_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported seeds per scene, with the templates that their intents had before."""
    rows = table(spark, sf_dir, "seed_cases_template").select(F.trim("case_id").alias("case_id"), "scene_id").where("case_id <> '' and scene_id is not null").distinct()
    carried = seeds.carried_templates(rows, table(spark, sf_dir, "capability_intents").select(F.col("capability_id").alias("scene_id"), F.trim("case_id").alias("case_id"), "template_id"))
    return carried.groupBy("scene_id").agg(F.count("*").alias("n_seeds"), F.count("template_id").alias("n_templates"))


@register(f"SELECT id, '{{\"id\":\"' || id || '\",\"n\":' || length(coalesce(text, '')) || '}}' AS json FROM {GOLDEN}")
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision as one JSON text."""
    rows = table(spark, sf_dir, GOLDEN).select("id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return sinks.as_json(rows).select(F.get_json_object("json", "$.id").alias("id"), "json")


@register("""WITH q AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0)
  SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(item_id AS VARCHAR) AS doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rn FROM q WHERE query_id % 300 = 0) WHERE rn <= 3""")
def table_search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search client over an index table, the label standing for the scene; ids divisible by 300 ask, each within its label."""
    folder = _folder(spark, "search")
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("scene_id"), F.col("embedding").alias("vector"))
    docs.write.parquet(f"{folder}/docs")
    client = search.build_client(spark, "table", folder)
    if not search.ready(client, "docs"):
        raise RuntimeError("no index")
    asked = client.docs("docs").where("cast(id as bigint) % 300 = 0").withColumnRenamed("id", "query_id")
    out = None
    for label in [r.scene_id for r in asked.select("scene_id").distinct().orderBy("scene_id").collect()]:  # labels are few
        hits = client.vector("docs", asked.where(F.col("scene_id") == label), "query_id", "vector", 3, label)
        out = hits if out is None else out.unionByName(hits)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register(f"""SELECT id, contains(lower(coalesce(text, '')), 'cpu') AND coalesce(role, '') <> 'viewer' AS asked, CASE WHEN contains(lower(coalesce(text, '')), 'cpu') AND coalesce(role, '') <> 'viewer' THEN length(text) END AS said FROM {GOLDEN}""")
def model_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model behind an injected transport is asked for unsure requests alone, with whole texts; it answers their length."""
    from switchyard.sources import services

    def transport():
        import json

        return lambda request: json.dumps({"choices": [{"message": {"content": str(len(request["input"]))}}]})

    unsure = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("cpu")) & (F.coalesce("role", F.lit("")) != "viewer")
    rows = table(spark, sf_dir, GOLDEN).select("id", "text", unsure.alias("asked"))
    return services.ask_model(rows, "text", "asked", transport, most_chars=None).select("id", "asked", F.col("answer").cast("bigint").alias("said"))


@register(f"SELECT id, round(1.0e0, 6) AS same, true AS unit FROM {GOLDEN}")
def query_vectors_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors computed once for each distinct text, of unit length, and equal to those computed row by row."""
    rows = table(spark, sf_dir, GOLDEN).select("id", text.normalize_text(F.col("text")).alias("norm"))
    encoder = scoring.make_embedder({"provider": "hash", "dimension": 32})
    cached = retrieve.with_query_vectors(rows, "norm", encoder, "query: ")
    both = cached.withColumn("again", scoring.embed(F.col("norm"), encoder, "query: "))
    return both.select("id", F.round(scoring.cosine(F.col("query_vector"), F.col("again")), 6).alias("same"), (F.abs(scoring.norm(F.col("query_vector")) - 1) < 1e-9).alias("unit"))


QUERIES, SQL = register.queries, register.sql

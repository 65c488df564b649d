"""Sources: JSON, JSONL and CSV tables, dictionaries, benchmark cases, index scans, search backends."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchyard.functions.text import bool_word, clamp, first_non_blank, is_json, uni_trim
from switchyard.session import materialize

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}
TERM_SCHEMA = "term string, domain string, slot string, slot_name string, value string, slot_value string, entity_id string, entity_name string, score double, aliases array<string>, word_boundary string, metadata map<string,string>"
CASE_SCHEMA = "id string, text string, expected struct<type:string,scene:string,template_id:string,out_of_scope_reason:string,missing_slots:array<string>>, tags string, weight double, role string, tenant_id string, context struct<scene:string,flow_type:string,clarify_round:string>"


def detect_format(path: str, given: str | None = None) -> str:
    kind = given or FORMATS.get(Path(path).suffix.lower())
    if kind not in ("csv", "json", "jsonl"):
        raise ValueError(f"unknown format of {path}")
    return kind


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of every line of text files, which may be cut in blocks: lines are counted per block, and blocks added up."""
    block = ["file", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = materialize(lines.withColumn("at", F.monotonically_increasing_id()))
    blocks = lines.groupBy(*block).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select(*block, (before - F.col("first") + 1).alias("offset"))
    return lines.join(offsets, block).select("file", (F.col("at") + F.col("offset")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped. `line_no` tells the line; `reason` is invalid_json or not_object where it holds no object, else null."""
    lines = numbered_lines(spark, path).where(uni_trim(F.col("value")) != "")
    bad = F.when(~is_json(F.col("value")), "invalid_json").when(~uni_trim(F.col("value")).startswith("{"), "not_object")
    parsed = lines.select("file", "line_no", "value", bad.alias("reason"), F.from_json("value", schema).alias("r"))
    return parsed.select("r.*", "line_no", "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("_corrupt_record"))


def require_lines(rows: DataFrame) -> DataFrame:
    """rows of read_jsonl, or ValueError with the first line that holds no object."""
    bad = rows.where("reason is not null").orderBy("line_no").select("line_no", "reason").first()
    if bad:
        raise ValueError(f"line {bad.line_no}: {bad.reason}")
    return rows.drop("line_no", "reason", "_corrupt_record")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header row, all fields as text by name, quoted line breaks allowed, a byte order mark ignored."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    names = [f.split()[0] for f in schema.split(",")]
    return raw.select(*(F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names))


def read_rows(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    kind = detect_format(path, kind)
    return read_csv(spark, path, schema) if kind == "csv" else read_json_list(spark, path, schema) if kind == "json" else read_jsonl(spark, path, schema)


def load_config(folder: str, names: tuple[str, ...] = ("capabilities", "rules", "thresholds", "vector")) -> dict:
    """Small configuration files, read on the driver."""
    return {n: json.loads(Path(folder, f"{n}.json").read_text(encoding="utf-8")) for n in names}


def capability_list(payload: list | dict) -> tuple[list, dict]:
    """A bare list of capabilities, or an object of `capabilities` and `slot_policy_defaults`."""
    if isinstance(payload, list):
        return payload, {}
    if not isinstance(payload.get("capabilities"), list):
        raise ValueError("no list of capabilities")
    return payload["capabilities"], payload.get("slot_policy_defaults") or {}


def flatten_terms(payload: list | dict) -> list[dict]:
    """Terms of a list, or of `terms` and `domains`, whose name is a default for the term's domain."""
    if isinstance(payload, list):
        return [t for t in payload if isinstance(t, dict)]
    flat = [t for t in payload.get("terms") or [] if isinstance(t, dict)]
    return flat + [{"domain": d, **t} for d, ts in (payload.get("domains") or {}).items() for t in ts if isinstance(t, dict)]


def resolve_terms(config: dict) -> list[dict]:
    """Inline terms win over the dictionary file; a missing file gives none."""
    if config.get("terms"):
        return flatten_terms(config["terms"])
    path = config.get("dictionary_path")
    return flatten_terms(json.loads(Path(path).read_text(encoding="utf-8"))) if path and Path(path).exists() else []


#: Fixed value: the score of a term that has none.
TERM_SCORE = 0.99


def term_rows(spark: SparkSession, terms: list[dict], default_domain: str = "default") -> DataFrame:
    """Typed term rows: slot or slot_name, value or slot_value, clamped score, tri-state word boundary, metadata; `ord` is the place in the list."""
    lines = [(i, json.dumps(t, ensure_ascii=False)) for i, t in enumerate(terms)]
    t = spark.createDataFrame(lines, "ord bigint, j string").select("ord", F.from_json("j", TERM_SCHEMA).alias("t")).select("ord", "t.*")
    return t.where(uni_trim(F.col("term")) != "").select(
        uni_trim(F.col("term")).alias("term"), first_non_blank(F.col("domain"), F.lit(default_domain)).alias("domain"), first_non_blank(F.col("slot"), F.col("slot_name")).alias("slot"), F.coalesce("value", "slot_value").alias("value"), "entity_id", "entity_name",
        clamp(F.coalesce("score", F.lit(TERM_SCORE))).alias("score"), "aliases", bool_word(F.col("word_boundary"), None).alias("word_boundary"), "metadata", "ord",
    )


def scan_index(spark: SparkSession, path: str, most: int | None = None, offset: int = 0, kind: str | None = None) -> DataFrame:
    """Documents of an index table; most and offset are for paging, in order of id. The format is told by `kind` or the path's suffix, else parquet."""
    kind = kind or {".json": "json", ".jsonl": "json", ".orc": "orc", ".csv": "csv"}.get(Path(path).suffix.lower(), "parquet")
    docs = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
    if most is None and not offset:
        return docs
    docs = docs.orderBy("id").offset(offset)
    return docs if most is None else docs.limit(most)


def existing_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an exported dictionary, a list or an object of lists; a missing file gives none."""
    there = Path(path).exists()
    return term_rows(spark, flatten_terms(json.loads(Path(path).read_text(encoding="utf-8"))) if there else [])


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation set with `reason` where id, text or expected is missing or tags are no list; a blank role is none."""
    c = read_json_list(spark, path, CASE_SCHEMA)
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    listed = F.from_json("tags", "array<string>")
    reason: Column = F.when(blank(F.col("id")), "id").when(blank(F.col("text")), "text").when(F.col("expected").isNull(), "expected").when(F.col("tags").isNotNull() & (~F.trim("tags").startswith("[") | listed.isNull()), "tags")
    return c.withColumn("reason", reason).withColumns({"tags": listed, "role": F.when(~blank(F.col("role")), F.col("role")), "weight": F.coalesce("weight", F.lit(1.0))})


#: Fields of a request and whether they must be there.
REQUEST_FIELDS = {"input_text": True, "tenant_id": False, "role": False, "context": False}


def single_request(spark: SparkSession, request: dict) -> DataFrame:
    """One request as a table of one row; ValueError if input_text is missing or a field is unknown."""
    lost = [f for f, needed in REQUEST_FIELDS.items() if needed and not isinstance(request.get(f), str)]
    unknown = sorted(set(request) - set(REQUEST_FIELDS))
    if lost or unknown:
        raise ValueError(f"missing: {lost}, unknown: {unknown}")
    return spark.createDataFrame([(request["input_text"], request.get("tenant_id"), request.get("role"), json.dumps(request.get("context") or {}))], "input_text string, tenant_id string, role string, context string")


def health(spark: SparkSession, *names: str) -> dict:
    """What a health check answers: ok or not, and the tables that are missing."""
    lost = [n for n in names if not spark.catalog.tableExists(n)]
    return {"status": "unavailable" if lost else "ok", "missing": lost}


def enabled_rows(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("enabled"), F.lit(True)))


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of one key; a filter that reaches the scan."""
    return df.where(F.col(key) == value)


def by_scene(df: DataFrame, scene: str) -> DataFrame:
    """Enabled rows of a scene."""
    return enabled_rows(df).where(F.col("scene_id") == scene)


def resolve_backend(argument: str | None = None, env: str | None = None, config: str | None = None, default: str = "opensearch") -> str:
    """Search backend by argument, environment variable, configuration, default; `es` is short for elasticsearch."""
    name = next((x for x in (argument, os.environ.get(env) if env else None, config) if x and x.strip()), default).strip().lower()
    name = {"es": "elasticsearch"}.get(name, name)
    if name not in ("opensearch", "elasticsearch", "table"):
        raise ValueError(f"unknown search backend {name}")
    return name


def table_ready(spark: SparkSession, *names: str) -> bool:
    return all(spark.catalog.tableExists(n) for n in names)

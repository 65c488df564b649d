"""Sinks: JSON rows, single pretty files, rejects, index tables with upsert, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators.evaluate import enforce_gates
from switchyard.operators.seeds import upsert
from switchyard.session import materialize


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_pretty(df: DataFrame, path: str, order: list[str], most: int = 100_000) -> int:
    """One pretty JSON list in a local file, for small results; more rows than `most` are refused."""
    rows = [json.loads(r.json) for r in as_json(df.orderBy(*order)).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError("too many rows for one file")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")
    return len(rows)


def write_split(df: DataFrame, good: str, rejects: str, reason: str = "reason") -> None:
    """Valid rows and rejects to two folders."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(good)
    df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(rejects)


def write_summary(summary: DataFrame, path: str, least: dict[str, float] | None = None) -> dict:
    """A one-row report as a JSON file; it is written before its gates are enforced."""
    row = json.loads(as_json(summary).first().json)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2), encoding="utf-8")
    enforce_gates(summary, least or {})
    return row


INDEX = "id string, scene_id string, template_id string, text string, metadata string, vector array<float>"
#: Parts of an index table by hash of the id; an upsert rewrites those it touches.
PARTS = 64


def _parted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))


def ensure_index(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """The index table at path, made empty if there is none; its vectors must have the dimension."""
    try:
        docs = spark.read.schema(f"{INDEX}, part int").parquet(path)
    except Exception:  # noqa: BLE001 - no table yet
        _parted(spark.createDataFrame([], INDEX)).write.partitionBy("part").parquet(path)
        return spark.read.schema(f"{INDEX}, part int").parquet(path).drop("part")
    if docs.where(F.size("vector") != dimension).limit(1).count():
        raise ValueError(f"vectors of {path} have not {dimension} dimensions")
    return docs.drop("part")


def bulk_upsert(spark: SparkSession, path: str, docs: DataFrame, dimension: int) -> DataFrame:
    """The index at path with docs written over it by id. Only the parts that docs fall into are read and written anew."""
    if docs.where(F.size("vector") != dimension).limit(1).count():
        raise ValueError(f"a vector has not {dimension} dimensions")
    ensure_index(spark, path, dimension)
    new = _parted(docs.select(*(c.split()[0] for c in INDEX.split(", "))))
    touched = [r.part for r in new.select("part").distinct().collect()]  # at most PARTS
    old = spark.read.schema(f"{INDEX}, part int").parquet(path).where(F.col("part").isin(touched))
    # Written aside first: the parts that are replaced are being read.
    merged = materialize(upsert(old, new, "id").drop("origin"))
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return ensure_index(spark, path, dimension)

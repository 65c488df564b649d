"""Evaluation of predictions: accuracy, weighted accuracy, stability over repeats, per type; run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(expected: dict[str, Column], actual: dict[str, Column], subset: tuple[Column, Column] | None = None) -> Column:
    """Whether every expected value that is not null is equal, and expected is a subset of actual for arrays."""
    ok = F.lit(True)
    for name, e in expected.items():
        ok = ok & (e.isNull() | F.coalesce(e == actual[name], F.lit(False)))
    if subset:
        e, a = subset
        ok = ok & (e.isNull() | (F.size(F.array_except(e, F.coalesce(a, F.array().cast("array<string>")))) == 0))
    return ok


def failure_reason(expected: dict[str, Column], actual: dict[str, Column], subset: tuple[str, Column, Column] | None = None) -> Column:
    """Names of the differing keys, joined; empty if none. subset: a name and two arrays, of which the second must hold the first."""
    parts = [F.when(e.isNotNull() & ~F.coalesce(e == actual[n], F.lit(False)), n) for n, e in expected.items()]
    if subset:
        name, e, a = subset
        parts.append(F.when(F.size(F.array_except(e, F.coalesce(a, F.array().cast("array<string>")))) > 0, name))
    return F.concat_ws(",", *parts)


def accuracy(results: DataFrame, ok: str = "ok", weight: str = "weight") -> DataFrame:
    good = F.when(F.col(ok), 1).otherwise(0)
    return results.agg(F.count("*").alias("total"), F.sum(good).alias("passed"), F.sum(1 - good).alias("failed"), F.round(F.sum(F.col(weight) * good) / F.sum(weight), 6).alias("weighted_accuracy"), F.round(F.avg(good), 6).alias("exact_accuracy"))


def accuracy_by(results: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    good = F.when(F.col(ok), 1).otherwise(0)
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.sum(good).alias("passed"), F.round(F.avg(good), 6).alias("accuracy"))


def stability(runs: DataFrame, case: str, signature: list[str]) -> DataFrame:
    """Share of cases whose repeats all have one signature."""
    sign = F.sha2(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}), 256)
    per = runs.groupBy(case).agg(F.min(sign).alias("a"), F.max(sign).alias("b"))
    return per.agg(F.count("*").alias("total"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("stable"), F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("stability"))


def decision_metrics(results: DataFrame, sets: list[str], value: str) -> DataFrame:
    """Counts, mean and 95th percentile (a sketch, exact up to 10,000 values) of value for each of the columns alone and in total, in one pass (grouping sets)."""
    cube = results.groupingSets([[F.col(c)] for c in sets] + [[]], *map(F.col, sets))
    return cube.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.percentile_approx(value, 0.95), 6).alias("p95"))


class GateError(RuntimeError):
    """An evaluation below its gate."""


def enforce_gates(summary: DataFrame, least: dict[str, float]) -> None:
    """Raises GateError if a figure of the one-row summary is below its minimum."""
    row = summary.first()
    low = {k: row[k] for k, v in least.items() if row[k] is None or row[k] < v}
    if low:
        raise GateError(f"below the gate: {low}")

"""Ranking operators: top-k, gaps, gates, normalising, fusion, best per key. Ties break on an ordinal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import materialize


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each partition to k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def with_places(df: DataFrame, *order: str) -> DataFrame:
    """df with `place`, from 1, in the given order over all rows. Rows are counted by sorted partition, so none is moved into one task."""
    sorted_rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def best_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "_best").drop("_best")


def top_gap(df: DataFrame, by: list[str], item: str, score: str, ordinal: str) -> DataFrame:
    """Per group: top1 item and score, top2 score (0 if none) and their gap, by one combining aggregation."""
    first2 = top_k(df, by, [F.col(score).desc(), F.col(ordinal)], 2)
    one = F.col("rank") == 1
    out = first2.groupBy(*by).agg(F.max(F.when(one, F.col(item))).alias("top1"), F.max(F.when(one, F.col(score))).alias("top1_score"), F.coalesce(F.max(F.when(~one, F.col(score))), F.lit(0.0)).alias("top2_score"))
    return out.withColumn("gap", F.col("top1_score") - F.col("top2_score"))


def gate(top1: Column, gap: Column, least_score: float, least_gap: float) -> Column:
    """refuse below the score, clarify below the gap, else pass."""
    return F.when(top1.isNull() | (top1 < least_score), "refuse").when(gap < least_gap, "clarify").otherwise("pass")


def commit(top1: Column, top2: Column, least_score: float, least_gap: float) -> Column:
    """Whether the best candidate is sure enough to be taken; its gap is its score if it is the only one."""
    return F.coalesce((top1 >= least_score) & (top1 - F.coalesce(top2, F.lit(0.0)) >= least_gap), F.lit(False))


def max_normalise(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """score divided by its group's maximum (by 1 if that is 0 or null)."""
    top = F.coalesce(F.nullif(F.max(score).over(W.partitionBy(*by)), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.col(score) / top)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, query: str, item: str, w_vector: float = 0.7, w_text: float = 0.3) -> DataFrame:
    """Weighted sum of both lists' max-normalised scores, a missing side counting 0.

    Union and one aggregation instead of a full outer join: both sides move once.
    """
    both = vector_hits.select(query, item, F.col("score").alias("v"), F.lit(None).cast("double").alias("t")).unionByName(text_hits.select(query, item, F.lit(None).cast("double").alias("v"), F.col("score").alias("t")))
    per = both.groupBy(query, item).agg(F.max("v").alias("v"), F.max("t").alias("t"))
    per = max_normalise(max_normalise(per, [query], "v", "vn"), [query], "t", "tn")
    return per.select(query, item, (F.lit(w_vector) * F.coalesce("vn", F.lit(0.0)) + F.lit(w_text) * F.coalesce("tn", F.lit(0.0))).alias("score"))


def first_decision(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], decision: str = "decision") -> DataFrame:
    """Runs stages in order; each adds the column `_d`, null to pass on. The first that is not null decides.

    Stages are built-in expressions, whose CASE is lazy. A stage with a Python function or a join should be
    wrapped in only_undecided, so that decided rows do not enter it.
    """
    df = df.withColumn(decision, F.lit(None).cast("string"))
    for stage in stages:
        df = stage(df).withColumn(decision, F.coalesce(decision, "_d")).drop("_d")
    return df


def only_undecided(stage: Callable[[DataFrame], DataFrame], decision: str = "decision") -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        done = df.where(F.col(decision).isNotNull()).withColumn("_d", F.lit(None).cast("string"))
        return stage(df.where(F.col(decision).isNull())).unionByName(done, allowMissingColumns=True)

    return run


def distinct_in_order(df: DataFrame, by: list[str], key: list[str], ordinal: str, limit: int) -> DataFrame:
    """The first `limit` distinct keys of each group, in order of first appearance."""
    firsts = df.groupBy(*by, *key).agg(F.min(ordinal).alias(ordinal))
    return top_k(firsts, by, [F.col(ordinal), *map(F.col, key)], limit)


def ordered_union(limit: int, *arrays: Column) -> Column:
    """Distinct elements of arrays in order of preference, cut to limit."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(*(F.coalesce(a, empty) for a in arrays))), 1, limit)

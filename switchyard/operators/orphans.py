"""References to records that do not exist: as-of match of references to runs of parent keys.

Parents have lifetimes [start, end). What a reference can land on is a pair of key and microsecond, so
the lifetimes of a key are ranges of consecutive integers; sorted, overlapping and touching ones are
compressed into contiguous runs. A reference is matched as of the preceding run start of its key and is
an orphan if it lies beyond that run's end (`deleted`), before all runs of its key (`late`), or if no
parent has the key (`missing`).

Defined cases: null reference keys are no references; a null reference time lies in no lifetime and
after no start, so the row is an orphan, `late` or `missing`; parents with a null key are ignored; a
parent with a null start has a key but no lifetime; one that ends at or before its start has begun but
holds nothing; a null end is open; keys compare exactly; repeated parents are one run; without parents
every reference is `missing`; other columns of the inputs do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import BROADCAST_ROWS, is_small

_OPEN = (1 << 63) - 1


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parent_runs(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """ref_key, run_start, run_end (exclusive): contiguous runs of each key; nulls for a key without a start."""
    p = parents.where(F.col(key).isNotNull()).select(F.col(key).alias("ref_key"), _micros(F.col(start)).alias("s"), F.coalesce(_micros(F.col(end)), F.lit(_OPEN)).alias("e"))
    p = p.withColumn("e", F.when(F.col("s").isNotNull(), F.greatest("s", "e"))).distinct()
    by = W.partitionBy("ref_key").orderBy(F.col("s").asc_nulls_first(), "e")
    reached = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("fresh", F.when(reached.isNull() | (F.col("s") > reached), 1).otherwise(0))
    p = p.withColumn("run", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return p.groupBy("ref_key", "run").agg(F.min("s").alias("run_start"), F.max("e").alias("run_end")).drop("run")


def find_orphans(refs: DataFrame, parents: DataFrame, ref_id: str, ref_key: str, ref_time: str, key: str, start: str, end: str, small_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """ref_id (string), ref_time, kind of every orphan.

    The parents are counted. Up to small_rows of them, the runs of each key are sent to the executors as
    one sorted array and references are matched where they are, without a shuffle. Beyond, runs and
    references come together by key and salt, runs copied to every salt so that a hot key is spread,
    and one ordered pass matches them.
    """
    refs = refs.where(F.col(ref_key).isNotNull()).select(
        F.col(ref_id).cast("string").alias("ref_id"), F.col(ref_key).alias("ref_key"), F.col(ref_time).cast("timestamp").alias("ref_time"), _micros(F.col(ref_time)).alias("at")
    )
    runs = parent_runs(parents, key, start, end)
    matched = _match_arrays(refs, runs) if is_small(parents, small_rows) else _match_ordered(refs, runs, salts)
    inside = F.coalesce(F.col("at") < F.col("run.run_end"), F.lit(False))
    kind = F.when(~F.col("known"), "missing").when(F.col("run").isNotNull(), "deleted").otherwise("late")
    return matched.where(~inside).select("ref_id", "ref_time", kind.alias("kind"))


def _match_arrays(refs: DataFrame, runs: DataFrame) -> DataFrame:
    per_key = runs.groupBy("ref_key").agg(F.sort_array(F.collect_list(F.struct("run_start", "run_end"))).alias("runs"))
    run = F.try_element_at(F.filter("runs", lambda r: r["run_start"] <= F.col("at")), F.lit(-1))
    return refs.join(F.broadcast(per_key), "ref_key", "left").select("ref_id", "ref_time", "at", F.col("runs").isNotNull().alias("known"), run.alias("run"))


def _match_ordered(refs: DataFrame, runs: DataFrame, salts: int) -> DataFrame:
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = runs.select("ref_key", every.alias("salt"), F.col("run_start").alias("at"), F.struct("run_start", "run_end").alias("own"))
    right = refs.select("ref_key", F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int").alias("salt"), "at", "ref_id", "ref_time", F.lit(True).alias("is_ref"))
    both = left.unionByName(right, allowMissingColumns=True)
    group = W.partitionBy("ref_key", "salt").orderBy(F.col("at").asc_nulls_first(), F.col("is_ref").asc_nulls_first())
    so_far = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    run = F.last(F.when(F.col("at").isNotNull(), F.col("own")), ignorenulls=True).over(so_far)
    first = F.min(F.when(F.col("is_ref").isNull(), 1)).over(W.partitionBy("ref_key", "salt").orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = both.withColumn("run", run).withColumn("known", first.isNotNull()).where("is_ref")
    return out.select("ref_id", "ref_time", "at", "known", "run")


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphans per ref_table, calendar month of the reference's time, and kind."""
    return orphans.groupBy("ref_table", F.date_format("ref_time", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n_orphans"))

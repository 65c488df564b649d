"""Filling containers of fixed capacity with items (problem 7): a configuration linear program.

A configuration is a multiset of lengths that fits a container. The program asks how often to use each
configuration so that all items of the length histogram are covered with the fewest containers. It is
solved by multiplicative weights: lengths have prices, the best configuration under them is found by
knapsack dynamic programming, the configurations of nearly best value are taken a step each, and the
prices of what they cover fall by a factor. The result is rounded down, and what remains is filled in
runs of first-fit-decreasing patterns. Each capacity is solved by one task from its histogram, which has at
most `capacity` rows whatever the data; the plan comes out as ranges of ranks within each length, which all
tasks are given, and every item finds its container by its rank.

Defined cases: items of no length, null texts and empty texts are not placed; an item above the capacity
is split into full containers and one remainder, pieces counted from 0; repeated items are items of
their own; no items give no containers; capacities must be positive.
"""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import materialize

#: Rounds of multiplicative weights, step and tolerance, and configurations taken per round.
ROUNDS, STEP, NEAR, PER_ROUND = 120, 0.25, 0.02, 64
#: Times the program is solved for what rounding left.
AGAIN = 3
#: Columns of a plan as a table.
_PLAN = ("length", "start", "base", "per")
#: Items of one length that are ranked in one task.
RANKED_TOGETHER = 100_000


def _price(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity, and the index of a length used for it (-1: one unit left empty)."""
    best, used = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c] = best[c - 1]
        if k:
            values = prices[:k] + best[c - lengths[:k]]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-15:
                best[c], used[c] = values[i], i
    return best, used


def _configuration(first: int, lengths: np.ndarray, used: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """Counts of lengths in the best configuration that holds the length with index first."""
    counts: dict[int, int] = {first: 1}
    c = capacity - int(lengths[first])
    while c > 0:
        i = int(used[c])
        if i < 0:
            c -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            c -= int(lengths[i])
    return tuple(sorted(counts.items()))


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Fractional uses of configurations, from multiplicative weights."""
    uses: dict[tuple, float] = {}
    covered, n = np.zeros(len(lengths)), counts.astype(float)
    for _ in range(ROUNDS):
        ratio = covered / n
        prices = lengths / capacity * np.exp(-(ratio - ratio.min()))
        best, used = _price(lengths, prices, capacity)
        value = prices + best[capacity - lengths]
        near = np.flatnonzero(value >= (1 - NEAR) * value.max())
        near = near[np.argsort(ratio[near], kind="stable")][:PER_ROUND]
        for config in dict.fromkeys(_configuration(int(i), lengths, used, capacity) for i in near):
            step = STEP * min(n[i] / a for i, a in config)
            uses[config] = uses.get(config, 0.0) + step
            for i, a in config:
                covered[i] += a * step
        if (covered >= n).all():
            break
    scale = max(1e-9, float(np.average(covered / n, weights=lengths * n)))
    return {c: x / scale for c, x in uses.items()}


@dataclass
class Plan:
    """Ranges of ranks: items of `length` from rank `start` on go to containers from `base` on, `per` in each."""

    length: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    containers: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        order = np.lexsort((self.start, self.length))
        return tuple(np.array(x, dtype=np.int64)[order] for x in (self.length, self.start, self.base, self.per))


class _Builder:
    """A plan in the making: what is left of each length and where the next rank goes."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity, self.left = lengths, capacity, counts.copy()
        self.placed, self.plan = np.zeros(len(lengths), dtype=np.int64), Plan()

    def take(self, config: tuple[tuple[int, int], ...], times: int) -> None:
        for i, a in config:
            self.plan.length.append(int(self.lengths[i]))
            self.plan.start.append(int(self.placed[i]))
            self.plan.base.append(self.plan.containers)
            self.plan.per.append(a)
            self.placed[i] += a * times
            self.left[i] -= a * times
        self.plan.containers += times

    def round_down(self, uses: dict[tuple, float]) -> bool:
        """Takes the whole part of each configuration's use, the fullest first; whether there was any."""
        filled = lambda config: sum(int(self.lengths[i]) * a for i, a in config)
        any_taken = False
        for config, x in sorted(uses.items(), key=lambda e: (-filled(e[0]), -e[1], e[0])):
            times = min([int(x + 1e-9), *(int(self.left[i]) // a for i, a in config)])
            if times > 0:
                self.take(config, times)
                any_taken = True
        return any_taken

    def finished(self) -> Plan:
        """The plan with what is left filled by first-fit decreasing; this one goes on as it is."""
        other = deepcopy(self)
        other.first_fit()
        return other.plan

    def first_fit(self) -> None:
        """Fills what is left by first-fit-decreasing patterns, each repeated as long as its lengths last."""
        while self.left.any():
            config, room = [], self.capacity
            for i in np.flatnonzero(self.left)[::-1]:
                a = min(int(self.left[i]), room // int(self.lengths[i]))
                if a > 0:
                    config.append((int(i), a))
                    room -= a * int(self.lengths[i])
                if room < self.lengths[0]:
                    break
            self.take(tuple(config), min(int(self.left[i]) // a for i, a in config))


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """Containers for a histogram of lengths, none above the capacity.

    The program is solved and rounded down, and again for what remains while whole uses come out, at most
    AGAIN times and until the volume leaves nothing to gain. Of the plans so made, each finished by
    first-fit decreasing, the one with the fewest containers is kept; for a handful of items that may be
    first-fit decreasing alone.
    """
    if not histogram:
        return Plan()
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    solved, least = _Builder(lengths, counts, capacity), -(-int((lengths * counts).sum()) // capacity)
    greedy, plans = _Builder(lengths, counts, capacity), []
    for _ in range(AGAIN):
        some = np.flatnonzero(solved.left)
        if not len(some):
            break
        uses = solve_configurations(lengths[some], solved.left[some], capacity)
        whole = solved.round_down({tuple((int(some[i]), a) for i, a in config): x for config, x in uses.items()})
        plans.append(solved.finished())
        if not whole or plans[-1].containers == least:
            break
    return min([*plans, greedy.finished()], key=lambda p: p.containers)


def _pieces(items: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    of = F.explode(F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in specs)))
    each = items.select("doc_id", "n_tokens", of.alias("s")).select("doc_id", "n_tokens", "s.spec_id", "s.capacity")
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity"))
    each = each.withColumn("n_pieces", (last + 1).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("n_pieces") - 1))))
    begin = F.col("piece") * F.col("capacity")
    return each.select("spec_id", "capacity", "doc_id", "piece", "n_pieces", F.least(F.col("capacity"), F.col("n_tokens") - begin).alias("n_tokens"))


def _plans(counts: DataFrame, capacities: dict[str, int]) -> dict[str, tuple[np.ndarray, ...]]:
    """The plan of each spec, solved by a task of its own from the histogram, which has at most `capacity` rows."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        spec = rows["spec_id"].iloc[0]
        plan = plan_containers(dict(zip(rows["n_tokens"].tolist(), rows["n"].tolist())), capacities[spec])
        return pd.DataFrame(dict(zip(_PLAN, plan.arrays()))).assign(spec_id=spec)

    histogram = counts.groupBy("spec_id", "n_tokens").agg(F.sum("n").alias("n"))
    solved = histogram.repartition(len(capacities), "spec_id").groupBy("spec_id").applyInPandas(solve, "length bigint, start bigint, base bigint, per bigint, spec_id string")
    found = solved.toPandas()
    return {spec: tuple(found.loc[found["spec_id"] == spec].sort_values(["length", "start"])[c].to_numpy() for c in _PLAN) for spec in capacities}


def pack(sizes: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """spec_id, container, doc_id, piece, n_pieces, n_tokens, for sizes (doc_id, n_tokens) and specs (id, capacity).

    Items of one length are spread over hash buckets, ranked within each, and offset by the counts of the
    buckets before, so a length that a third of all items share is not ranked in one task.
    """
    if any(c <= 0 for _, c in specs):
        raise ValueError("capacities must be positive")
    sizes = materialize(sizes.select("doc_id", "n_tokens").where("n_tokens > 0"))
    pieces = _pieces(sizes, specs)
    buckets = max(1, sizes.count() // RANKED_TOGETHER)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = materialize(pieces.groupBy("spec_id", "n_tokens", "bucket").agg(F.count("*").alias("n")))
    plans = _plans(counts, dict(specs))
    sent = sizes.sparkSession.sparkContext.broadcast(plans)

    @F.pandas_udf("bigint")
    def container(spec: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(spec), dtype=np.int64)
        for s in spec.unique():
            at = np.flatnonzero((spec == s).to_numpy())
            lengths, starts, bases, pers = sent.value[s]
            l, r = length.to_numpy()[at].astype(np.int64), rank.to_numpy()[at].astype(np.int64)
            # Ranges are sorted by length and start; the last one at or before (length, rank) is its own.
            row = np.searchsorted(_joined(lengths, starts), _joined(l, r), side="right") - 1
            out[at] = bases[row] + (r - starts[row]) // pers[row]
        return pd.Series(out)

    before = W.partitionBy("spec_id", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("spec_id", "n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("spec_id", "n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["spec_id", "n_tokens", "bucket"])
    return ranked.select("spec_id", container("spec_id", "n_tokens", F.col("rank") + F.col("offset")).alias("container"), "doc_id", "piece", "n_pieces", "n_tokens")


def _joined(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << np.int64(42)) + rank


def fill_report(packed: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """Per spec: items, split documents, containers, the fewest possible by volume, and the share filled."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), F.count(F.when((F.col("piece") == 0) & (F.col("n_pieces") > 1), 1)).alias("split"))
    report = per.groupBy("spec_id").agg(F.sum("items").alias("n_items"), F.sum("split").alias("n_split_docs"), F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_in_one"))
    capacity = F.coalesce(*(F.when(F.col("spec_id") == s, F.lit(c)) for s, c in specs)).cast("bigint")
    return report.withColumn("capacity_tokens", capacity).withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6))


def violations(packed: DataFrame, sizes: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """Per spec, what must not be: containers above the capacity, documents split without need, documents of which tokens are missing
    or placed twice, and gaps in the numbers of containers."""
    capacity = F.coalesce(*(F.when(F.col("spec_id") == s, F.lit(c)) for s, c in specs)).cast("bigint")
    used = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("used"))
    full = used.groupBy("spec_id").agg(F.count(F.when(F.col("used") > capacity, 1)).alias("n_above"), (F.max("container") + 1 - F.count("*")).alias("n_gaps"))
    placed = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"))
    every = F.explode(F.array(*(F.lit(s) for s, _ in specs)))
    wanted = sizes.where("n_tokens > 0").select(every.alias("spec_id"), "doc_id", F.col("n_tokens").alias("whole"))
    both = wanted.join(placed, ["spec_id", "doc_id"], "full")
    wrong = both.groupBy("spec_id").agg(
        F.count(F.when(F.coalesce(F.col("whole") != F.col("placed"), F.lit(True)) | (F.col("pieces") != F.col("different")), 1)).alias("n_wrong"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("whole") <= capacity), 1)).alias("n_split"),
    )
    return full.join(wrong, "spec_id", "full").select("spec_id", "n_above", "n_gaps", "n_wrong", "n_split")

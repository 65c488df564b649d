"""Mixing sources to target weights (problem 8): Poisson replication.

Each source is to hold its share of a total of tokens, so its documents are used share * total / tokens
times on average. A document's count inverts the Poisson distribution at a uniform number hashed from
its id and a seed, cut at the source's cap; the Poisson mean is chosen so that the mean after the cut is
the target rate. Documents are exploded by their count and shuffled globally by a hash. A source whose
rate reaches its cap is used to the cap throughout and reported as limited.

Defined cases: null and empty texts have no tokens and are not used; documents without a source, or of
a source that is no target, are not used; a target without documents is reported with nothing; caps and
shares at or below zero use nothing; repeated documents are documents of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.session import BROADCAST_ROWS, materialize

SEED = 20_240_501
#: Values of all distributions together, up to which they are sent along; beyond, they are joined by source.
MOST_STEPS = 4_000_000


def _cut_cdf(mean: float, cap: int) -> list[float]:
    """P(Poisson(mean) <= k) for k below the cap. Terms in logarithms, as exp(-mean) is 0 for large means."""
    if mean <= 0:
        return [1.0] * cap
    total, log, out = 0.0, math.log(mean), []
    for k in range(cap):
        total += math.exp(k * log - mean - math.lgamma(k + 1))
        out.append(min(1.0, total))
    return out


def poisson_mean(rate: float, cap: int) -> float:
    """The mean whose Poisson distribution, cut at cap, has the mean rate (below cap)."""
    of = lambda mean: sum(1 - p for p in _cut_cdf(mean, cap))
    low, high = 0.0, 1.0
    while of(high) < rate:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if of(middle) < rate else (low, middle)
    return (low + high) / 2


@dataclass
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float
    limited: bool
    asked_tokens: int
    reachable_total: int | None
    cdf: list[float]


def plan_mix(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None = None) -> list[SourcePlan]:
    """Rates of the sources for a total of tokens, by default that of all their documents."""
    known = sum(tokens.get(s, 0) for s, _, _ in targets)
    total = known if total is None else total
    out = []
    for source, share, cap in targets:
        have, cap = tokens.get(source, 0), max(0, cap)
        want = max(0.0, share) * total / have if have else 0.0
        limited = want >= cap if have else share > 0
        rate = min(want, float(cap))
        cdf = [0.0] * cap if limited else _cut_cdf(poisson_mean(rate, cap), cap) if rate > 0 else [1.0] * cap
        reachable = int(cap * have / share) if share > 0 else None
        out.append(SourcePlan(source, share, cap, have, rate, limited, round(max(0.0, share) * total), reachable, cdf))
    return out


_PLAN = "source string, target_share double, max_repeats int, tokens bigint, rate double, limited boolean, asked_tokens bigint, reachable_total bigint, cdf array<double>"


def _planned(sizes: DataFrame, targets: DataFrame, total: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes of the targets' documents, the plan of each source, and whether the plans are small enough to be sent along.

    Plans are made where the targets are, each by itself, so their number is not bounded by the driver.
    """
    named = targets.where("source is not null").select("source", "target_share", "max_repeats")
    known = named.select("source").distinct()
    steps, sources = named.agg(F.coalesce(F.sum(F.greatest("max_repeats", F.lit(0))), F.lit(0)), F.count("*")).first()
    small = steps <= MOST_STEPS and sources <= BROADCAST_ROWS
    sizes = materialize(sizes.select("doc_id", "source", "n_tokens").join(F.broadcast(known) if small else known, "source", "left_semi"))
    sums = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    joined = named.join(sums, "source", "left").na.fill(0, ["tokens"])
    if total is None:
        total = joined.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def solve(batches):
        for batch in batches:
            plans = [plan_mix([(r.source, r.target_share or 0.0, int(r.max_repeats) if r.max_repeats == r.max_repeats and r.max_repeats is not None else 0)], {r.source: int(r.tokens)}, total)[0] for r in batch.itertuples()]
            yield pd.DataFrame([(p.source, p.target_share, p.max_repeats, p.tokens, p.rate, p.limited, p.asked_tokens, p.reachable_total, p.cdf) for p in plans], columns=[c.split()[0] for c in _PLAN.split(", ")]).astype({"reachable_total": "Int64"})

    return sizes, materialize(joined.mapInPandas(solve, _PLAN)), small


def _counts(sizes: DataFrame, plans: DataFrame, small: bool, seed: int) -> DataFrame:
    """sizes with `uses`: how often each document is used. Without a shuffle where the plans can be sent along."""
    plan = plans.select("source", "cdf")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    # The inverse: one use for each step of the distribution that the uniform number lies above.
    uses = F.size(F.filter("cdf", lambda p: F.col("u") > p))
    return sizes.withColumn("u", uniform).join(F.broadcast(plan) if small else plan, "source").withColumn("uses", uses).drop("u", "cdf")


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, copy (from 1), n_tokens and shuffle_key of the mix, in globally shuffled order."""
    sizes, plans, small = _planned(sizes, targets, total)
    used = _counts(sizes, plans, small, seed).where("uses > 0")
    copies = used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("shuffle_key", "doc_id", "copy")


def mix_report(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Per source: target and actual share, rate and tokens asked, documents used, most uses of one, whether its cap
    limits it, and the largest total for which its cap would not."""
    sizes, plans, small = _planned(sizes, targets, total)
    used = _counts(sizes, plans, small, seed).where("uses > 0")
    sums = used.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"))
    asked = plans.select("source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), F.round("rate", 6).alias("rate"), "limited", "asked_tokens", "reachable_total")
    joined = asked.join(sums, "source", "left").na.fill(0, ["n_docs", "n_uses", "most_uses", "n_tokens"])
    whole = sums.agg(F.sum("n_tokens").alias("whole"))
    return joined.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.round(F.col("n_tokens") / F.col("whole"), 6)).drop("whole")


def violations(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Per source, what must not be: documents used above its cap, tokens of no document, and a size further from the one that
    was asked for than chance allows (six standard deviations of a sum of independent uses), where its cap does not limit it."""
    mixed = mix(sizes, targets, total, seed)
    report = mix_report(sizes, targets, total, seed)
    per = mixed.groupBy("source", "doc_id").agg(F.max("copy").alias("uses"), F.count("*").alias("rows"), F.first("n_tokens").alias("n"))
    caps = targets.select("source", "max_repeats")
    over = per.join(caps, "source").groupBy("source").agg(F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("n_above"), F.count(F.when(F.col("uses") != F.col("rows"), 1)).alias("n_uneven"))
    # A use count cut at the cap varies no more than Poisson's, whose variance is its mean; the cut adds at most one.
    spread = sizes.groupBy("source").agg(F.sqrt(F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))).alias("root"))
    off = F.abs(F.col("n_tokens") - F.col("asked_tokens")) > 6 * F.col("root") * F.sqrt(F.col("rate") + 1)
    return report.join(over, "source", "left").join(spread, "source", "left").select("source", F.coalesce("n_above", F.lit(0)).alias("n_above"), F.coalesce("n_uneven", F.lit(0)).alias("n_uneven"), (F.coalesce(off, F.lit(False)) & ~F.col("limited")).alias("off"))

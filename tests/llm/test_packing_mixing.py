import random

import numpy as np

from switchyard.llm import mixing as M
from switchyard.llm import packing as P
from switchyard.llm import tokens


def check(packed, sizes, specs):
    rows = packed.collect()
    for spec, capacity in specs:
        own = [r for r in rows if r.spec_id == spec]
        used = {}
        for r in own:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
        assert not used or max(used.values()) <= capacity
        assert sorted(used) == list(range(len(used)))
        per = {}
        for r in own:
            per.setdefault(r.doc_id, []).append(r)
        assert set(per) == {d for d, n in sizes if n}
        for d, n in sizes:
            if n:
                pieces = sorted(per[d], key=lambda r: r.piece)
                assert sum(r.n_tokens for r in pieces) == n and [r.piece for r in pieces] == list(range(-(-n // capacity)))
                assert len(pieces) == 1 or n > capacity
        yield spec, len(used), sum(n for _, n in sizes)


def test_pack(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 7, 7, 7, int(rng.lognormvariate(4, 1)) + 1])) for i in range(4000)] + [(4000, 0), (4001, 100_000), (4002, 256), (4003, 257)]
    monkeypatch.setattr(P, "RANKED_TOGETHER", 300)
    specs = [("a", 256), ("b", 512)]
    df = spark.createDataFrame([(d, n, "x") for d, n in sizes], "doc_id bigint, n_tokens bigint, bucket string")
    for spec, n, total in check(P.pack(df, specs), sizes, specs):
        assert n <= -(-total // dict(specs)[spec]) * 1.01 + 1
    report = {r.spec_id: r for r in P.fill_report(P.pack(df, specs), specs).collect()}
    assert report["a"].fill > 0.99 and report["a"].most_in_one <= 256 and report["a"].n_split_docs == sum(n > 256 for _, n in sizes)


def test_pack_edges(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert P.pack(spark.createDataFrame([], schema), [("a", 8)]).count() == 0
    sizes = [(i, 5) for i in range(7)]
    assert list(check(P.pack(spark.createDataFrame(sizes, schema), [("a", 8)]), sizes, [("a", 8)])) == [("a", 7, 35)]
    thirds = [(i, x) for i, x in enumerate([6, 3, 1] * 50)]
    assert list(check(P.pack(spark.createDataFrame(thirds, schema), [("a", 10)]), thirds, [("a", 10)])) == [("a", 50, 500)]


def least_containers(hist, capacity):
    """Lower bound: items above capacity - k stand alone, the rest must fit the room they leave, for every k up to a half."""
    best = -(-sum(n * c for n, c in hist.items()) // capacity)
    for k in range(capacity // 2 + 1):
        big = sum(c for n, c in hist.items() if n > capacity - k)
        mid = [(n, c) for n, c in hist.items() if capacity / 2 < n <= capacity - k]
        small = sum(n * c for n, c in hist.items() if k <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in mid)
        best = max(best, big + sum(c for _, c in mid) + max(0, -(-(small - room) // capacity)))
    return best


def test_configurations_against_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(8):
        hist = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 100), 30, replace=False), rng.integers(1, 400, 30))}
        plan, least = P.plan_containers(hist, 100), least_containers(hist, 100)
        assert least <= plan.containers <= 1.02 * least + 2


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(1, "hello world 你好"), (2, ""), (3, None), (4, "a" * 30_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.sized(df, "doc_id", "text").collect()}
    enc = tokens._encoding(tokens.vocabulary_path())
    assert set(got) == {1, 4} and got[1] == len(enc.encode_ordinary("hello world 你好")) and enc.decode(enc.encode_ordinary("hello world 你好")) == "hello world 你好"


def test_poisson_mean():
    for cap in (1, 2, 4):
        for rate in (0.1, 0.5 * cap, 0.95 * cap):
            mean = M.poisson_mean(rate, cap)
            assert abs(sum(1 - p for p in M._cut_cdf(mean, cap)) - rate) < 1e-6


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.randrange(50, 150)) for i in range(20_000)] + [(20_001, "d", 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("d", 0.05, 4), ("none", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in M.mix_report(df, targets).collect()}
    tokens_of = {s: sum(n for _, x, n in rows if x == s) for s in "abcd"}
    total = sum(tokens_of.values())
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s].n_tokens / total - share) < 0.02 and not report[s].limited
    assert report["d"].limited and report["d"].n_uses == 4 and report["none"].limited and report["none"].n_tokens == 0
    got = M.mix(df, targets).collect()
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    caps = {"a": 1, "b": 3, "c": 2, "d": 4}
    of = {d: s for d, s, _ in rows}
    assert all(n <= caps[of[d]] for d, n in uses.items())
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert sum(r.n_tokens for r in got) == sum(r.n_tokens for r in report.values())
    assert sorted((r.doc_id, r["copy"]) for r in M.mix(df.repartition(7), targets).collect()) == sorted((r.doc_id, r["copy"]) for r in got)
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0


def test_poisson_mean_of_large_caps():
    for rate, cap in ((800.0, 2000), (1990.0, 2000), (590.0, 700), (5.0, 2000)):
        mean = M.poisson_mean(rate, cap)
        assert abs(sum(1 - p for p in M._cut_cdf(mean, cap)) - rate) < 1e-6
    (plan,) = M.plan_mix([("tiny", 0.8, 2000)], {"tiny": 10}, 10_000)
    assert not plan.limited and abs(sum(1 - p for p in plan.cdf) - 800) < 1e-6


def test_many_sources_are_joined(spark, monkeypatch):
    """Beyond the bound for sending the plans along the same documents are used."""
    sizes = spark.range(2000).selectExpr("id as doc_id", "concat('s', id % 40) as source", "1 + id % 9 as n_tokens")
    targets = spark.createDataFrame([(f"s{i}", 0.02 if i < 30 else None, 3 if i != 5 else None) for i in range(41)], "source string, target_share double, max_repeats int")
    used = lambda: sorted((r.doc_id, r.copy) for r in M.mix(sizes, targets, 6000).collect())
    sent = used()
    monkeypatch.setattr(M, "MOST_STEPS", 0)
    assert sent and used() == sent
    report = {r.source: r for r in M.mix_report(sizes, targets, 6000).collect()}
    assert len(report) == 41 and report["s35"].n_uses == 0 and report["s5"].n_uses == 0 and report["s5"].limited


def test_violations_are_seen(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 12)], "doc_id bigint, n_tokens bigint")
    good = P.pack(sizes, [("a", 10)])
    assert tuple(P.violations(good, sizes, [("a", 10)]).first())[1:] == (0, 0, 0, 0)
    bad = spark.createDataFrame([("a", 0, 1, 0, 2, 4), ("a", 0, 1, 1, 2, 1), ("a", 0, 2, 0, 1, 5), ("a", 2, 3, 0, 2, 10)], "spec_id string, container bigint, doc_id bigint, piece int, n_pieces int, n_tokens bigint")
    assert tuple(P.violations(bad, sizes, [("a", 8)]).first())[1:] == (2, 1, 1, 1)

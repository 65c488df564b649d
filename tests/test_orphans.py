import datetime
import random

from switchyard.operators.orphans import find_orphans, orphans_by_month, parent_runs

T = lambda d: None if d is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
P, R = "cap string, born timestamp_ntz, gone timestamp_ntz, ref_id string", "id bigint, scene string, at timestamp_ntz, kind string, runs string"


def brute(parents, refs):
    out = {}
    for i, key, at in refs:
        if key is None:
            continue
        own = [(a, b) for k, a, b in parents if k == key]
        if any(at is not None and a is not None and a <= at and (b is None or at < b) for a, b in own):
            continue
        out[str(i)] = "missing" if not own else "deleted" if any(at is not None and a is not None and a <= at for a, _ in own) else "late"
    return out


def run(spark, parents, refs, **how):
    p = spark.createDataFrame([(k, T(a), T(b), "x") for k, a, b in parents], P)
    r = spark.createDataFrame([(i, k, T(a), "x", "y") for i, k, a in refs], R)
    return {x.ref_id: x.kind for x in find_orphans(r, p, "id", "scene", "at", "cap", "born", "gone", **how).collect()}


def test_both_ways_agree_with_brute_force(spark):
    rng = random.Random(3)
    keys = ["a", "b", "c", "A", "a ", "", None]
    day = lambda: rng.choice([None, *range(12)])
    for _ in range(3):
        parents = [(rng.choice(keys), day(), day()) for _ in range(rng.choice([0, 6, 25]))]
        refs = [(i, rng.choice([*keys, "z"]), day()) for i in range(150)]
        expected = brute(parents, refs)
        assert run(spark, parents, refs) == expected
        assert run(spark, parents, refs, small_rows=-1, salts=3) == expected


def test_runs_are_merged(spark):
    p = spark.createDataFrame([("a", T(0), T(3), ""), ("a", T(3), T(5), ""), ("a", T(1), T(2), ""), ("a", T(8), None, ""), ("a", T(8), None, "")], P)
    assert parent_runs(p, "cap", "born", "gone").count() == 2


def test_months_and_empty(spark):
    assert run(spark, [], []) == {}
    r = spark.createDataFrame([(1, "a", T(0), "", ""), (2, "a", T(40), "", ""), (3, "a", T(41), "", "")], R)
    from pyspark.sql import functions as F

    found = find_orphans(r, spark.createDataFrame([], P), "id", "scene", "at", "cap", "born", "gone").withColumn("ref_table", F.lit("t"))
    assert sorted(tuple(x) for x in orphans_by_month(found).collect()) == [("t", "2024-01", "missing", 1), ("t", "2024-02", "missing", 2)]

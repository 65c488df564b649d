from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from switchyard.operators import ranking, retrieve


def test_knn_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype("float32")
    v[5] = v[6]
    rows = [(i, v[i].tolist(), int(i % 3), "x") for i in range(300)] + [(300, None, 0, "x"), (301, [0.0] * 8, 1, "x")]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>, label int, q string").repartition(5)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for most in (20_000, 7):
        monkeypatch.setattr(retrieve, "MOST_QUERIES", most)
        for same in (None, "label"):
            got = retrieve.knn(df.where("id % 20 = 0 and id < 300"), df, 4, "id", "id", "vec", same).toDF("q", "i", "score", "rank").collect()
            for q in range(0, 300, 20):
                s = u @ u[q]
                order = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != q and (not same or j % 3 == q % 3)][:4]
                assert [r.i for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == order
    assert retrieve.knn(df.limit(0), df, 4, "id", "id", "vec").count() == 0


def test_fuse(spark):
    a = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "q string, i string, score double")
    b = spark.createDataFrame([("q", "y", 5.0), ("q", "z", 2.5)], "q string, i string, score double")
    got = {r.i: round(r.score, 6) for r in ranking.fuse(a, b, "q", "i").collect()}
    assert got == {"x": 0.7, "y": 0.65, "z": 0.15}


def test_plan_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = ranking.top_k(df, ["g"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bm25_over_boosted_fields(spark):
    docs = spark.createDataFrame([(1, "core switch", None, ("north",), ["alpha", "beta"]), (2, "edge", "10.0.0.1", ("core",), None), (3, "edge edge", "10.0.0.2", (None,), ["core"]), (4, None, None, None, [])], "id int, name string, ip string, metadata struct<name: string>, aliases array<string>")
    asked = spark.createDataFrame([(1, "10.0.0.1"), (2, "beta"), (3, "core"), (4, "north"), (5, "nothing")], "q int, t string")
    fields = {"name": 3.0, "ip": 4.0, "metadata.name": 1.0, "aliases": 1.0}
    got = {}
    for r in retrieve.bm25_fields(asked, docs, "q", "t", "id", fields, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    assert {q: [d for d, _ in x] for q, x in got.items()} == {1: [2], 2: [1], 3: [1, 3], 4: [1]}
    names = {r.doc_id: round(3 * r.score, 6) for r in retrieve.bm25(asked.where("q = 3"), docs, "q", "t", "id", "name", 9).collect()}
    assert got[3][0] == (1, names[1])


def test_lexical(spark):
    items = spark.createDataFrame([("a", "s", ["cpu", "load"], ["Show CPU load"]), ("b", "s", ["cpu"], None), ("c", "t", [], ["show cpu loads", "zzz"]), ("d", "s", None, [])], "item string, scene string, keywords array<string>, examples array<string>")
    asked = spark.createDataFrame([(1, "show cpu load", "s"), (2, "zzz", "t"), (3, None, "s")], "id int, norm string, scene string")
    got = {(r.id, r["rank"]): (r.item, round(r.score, 6)) for r in retrieve.lexical(asked, items, 3, "id", "norm", "item", "keywords", "examples").collect()}
    near = round(SequenceMatcher(None, "show cpu load", "show cpu loads").ratio(), 6)
    assert [got[1, r] for r in (1, 2, 3)] == [("a", 1.0), ("b", 1.0), ("c", near)] and got[2, 1] == ("c", 1.0) and got[3, 1] == ("a", 0.0)
    same = {(r.id, r.item) for r in retrieve.lexical(asked, items, 9, "id", "norm", "item", "keywords", "examples", "scene").collect()}
    assert same == {(q, i) for q in (1, 3) for i in "abd"} | {(2, "c")}
    none = retrieve.no_hits(asked, "id", "item")
    assert none.count() == 0 and none.columns == ["id", "item", "score", "rank"]


def test_resolvers(spark):
    df = spark.createDataFrame([("北京 10.0.0.1 OLT-01 上海",), ("none",), (None,)], "t string")
    words = [(["核心路由器r1", " r1 "], "dev_r1", "R1", 0.85), (["olt-01"], "dev_olt_01", "OLT-01", 0.84)]
    regions = {"北京": ("region_bj", "北京"), "广州": ("region_gz", "广州"), "上海": ("region_sh", "上海")}
    a, b, c = df.select(retrieve.resolve_devices(F.col("t"), words).alias("d"), retrieve.resolve_regions(F.col("t"), regions).alias("r")).collect()
    assert [tuple(x) for x in a.d] == [("dev_10_0_0_1", "设备10.0.0.1", 0.9), ("dev_olt_01", "OLT-01", 0.84)]
    assert [tuple(x) for x in a.r] == [("region_bj", "北京", 0.88), ("region_sh", "上海", 0.88)] and not (b.d or b.r or c.d or c.r)


def test_bm25_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(vocabulary, size=rng.integers(1, 30), p=np.r_[0.3, np.full(59, 0.7 / 59)])) for i in range(200)} | {200: None, 201: ""}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, t string").repartition(3)
    words = {i: t.split() for i, t in texts.items() if t is not None}
    n, average = len(words), np.mean([len(w) for w in words.values()])
    df = {v: sum(v in w for w in words.values()) for v in vocabulary}

    def score(q, d):
        return sum(np.log(1 + (n - df[v] + 0.5) / (df[v] + 0.5)) * d.count(v) * 2.2 / (d.count(v) + 1.2 * (0.25 + 0.75 * len(d) / average)) for v in set(q))

    for queries, cells in ((20_000, 4_000_000), (7, 300)):
        monkeypatch.setattr(retrieve, "MOST_QUERIES", queries)
        monkeypatch.setattr(retrieve, "CELLS", cells)
        got = {}
        for r in retrieve.bm25(docs.where("id % 10 = 0"), docs, "id", "t", "id", "t", 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
        for q in range(0, 200, 10):
            expected = sorted(((round(score(words[q], d), 6), -i) for i, d in words.items()), reverse=True)[:4]
            assert [(-i, s) for s, i in expected] == [(i, s) for i, s in got[q]]
    assert retrieve.bm25(docs.limit(0), docs, "id", "t", "id", "t", 4).count() == 0 and retrieve.bm25(docs, docs.limit(0), "id", "t", "id", "t", 4).count() == 0

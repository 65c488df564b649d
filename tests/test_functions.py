import json
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from switchyard.functions import scoring, text
from switchyard.operators import dictionary, domains, evaluate, ranking, seeds, slots


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize(spark):
    got = values(spark, [("　 A，B。  c！",), (None,), ("",), ("x\ty　z",)], "t string", text.normalize_text(F.col("t")))
    assert got == [("a b c ",), (None,), ("",), ("x y z",)]


def test_tokens(spark):
    got = values(spark, [("B a，b  a/c",), (None,), (" ",)], "t string", text.tokenize(F.col("t")))
    assert got == [(["b", "a", "c"],), ([],), ([],)]


@pytest.mark.parametrize("t,expected", [("Top 10 最", 10), ("前５名", 5), ("top0", None), ("top 1001", None), ("none", None), (None, None), ("top99999999999999999999", None)])
def test_topn(spark, t, expected):
    assert values(spark, [(t,)], "t string", text.extract_topn(F.col("t"))) == [(expected,)]


def test_extracts(spark):
    t = F.col("t")
    rows = [("丢包率>5%", 5.0, None), ("超过 12.5 % at 10.0.0.1:80", 12.5, "10.0.0.1"), ("大于101%", None, None), ("1234.1.1.1 and 999.1.1.1", None, "999.1.1.1"), (None, None, None)]
    got = values(spark, [(r[0],) for r in rows], "t string", text.extract_percent(t), text.extract_ip(t))
    assert [g[0] for g in got] == [r[1] for r in rows]
    assert (got[1][1], got[3][1], got[0][1]) == ("10.0.0.1", "999.1.1.1", None)


def test_ipv4(spark):
    cases = {"1.2.3.4": True, "01.2.3.4": False, "256.1.1.1": False, "1.2.3": False, "1.2.3.4\n": False, None: False}
    got = values(spark, [(k,) for k in cases], "t string", text.is_ipv4(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_coercions(spark):
    rows = [(" Yes ", " 3 ", "a| b ,,c"), ("", "x", None), ("off", "-1", ""), (None, None, "|")]
    got = values(spark, rows, "b string, n string, t string", text.bool_word(F.col("b")), text.bool_word(F.col("b"), None), text.round_count(F.col("n"), 0, 0), text.round_count(F.col("n"), 1, 5), text.split_tags(F.col("t")))
    assert got == [(True, True, 3, 3, ["a", "b", "c"]), (False, None, 0, 5, []), (False, False, 0, 1, []), (False, None, 0, 5, [])]


def test_json_repairs(spark):
    rows = [('{"a":1}',), ('{\\"a\\":1}',), ("{“a”:1}",), ("{'a':1}",), ("nothing",), (None,)]
    got = [g[0] for g in values(spark, rows, "t string", text.repaired_json(F.col("t")))]
    assert [json.loads(g) if g else g for g in got] == [{"a": 1}] * 4 + [None, None]
    rows = [('```json\n{"a":1}\n```',), ('sure: {"a":1} ok',), ("no",)]
    got = [g[0] for g in values(spark, rows, "t string", text.embedded_json(F.col("t")))]
    assert [json.loads(g) if g else g for g in got] == [{"a": 1}, {"a": 1}, None]


def test_scores(spark):
    kws = F.array(F.lit("BGP"), F.lit("告警"))
    got = values(spark, [("bgp 告警",), ("x告警y",), ("",), (None,)], "t string", scoring.keyword_overlap(F.col("t"), text.tokenize(F.col("t")), kws))
    assert got == [(1.0,), (0.5,), (0.0,), (0.0,)]
    got = values(spark, [(float("nan"), 2.0), (None, -1.0), (0.5, 0.5)], "a double, b double", scoring.weighted_score([(0.6, F.col("a")), (0.4, F.col("b"))]))
    assert [round(g[0], 9) for g in got] == [0.4, 0.0, 0.5]


def test_slots(spark):
    s = spark.createDataFrame([({"a": "1", "b": "", "n": "0"},)], "s map<string,string>")
    need = F.array(*map(F.lit, "abcn"))
    assert s.select(scoring.coverage(F.col("s"), need), slots.missing(need, F.col("s"))).first() == (0.5, ["b", "c"])
    over = slots.overlay(F.col("s"), F.create_map(F.lit("a"), F.lit("2"), F.lit("n"), F.lit("")))
    assert s.select(over).first()[0] == {"a": "2", "b": "", "n": "0"}
    assert s.select(slots.applies(F.create_map(F.lit("a"), F.array(F.lit("1"))), F.col("s")), slots.applies(F.create_map(F.lit("z"), F.array(F.lit("1"))), F.col("s"))).first() == (True, False)


def test_sequence_ratio(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("abc", "ABC"), ("", ""), (None, "x"), ("x" * 300 + "ab", "ab" + "y" * 250)]
    got = [g[0] for g in values(spark, pairs, "a string, b string", scoring.sequence_ratio("a", "b"))]
    assert got == [0.0 if a is None else SequenceMatcher(None, a, b.lower()).ratio() for a, b in pairs]


def test_vectors(spark):
    got = values(spark, [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>", scoring.cosine(F.col("a"), F.col("b")), scoring.l2_normalise(F.col("a")))
    assert abs(got[0][0] - 0.96) < 1e-9 and got[1][0] == 0.0 and got[0][1] == [0.6, 0.8] and got[1][1] == [0.0, 0.0]
    v = spark.createDataFrame([("abc",), ("abc",), (None,)], "t string").select(scoring.embed(F.col("t"), scoring.hashed_embedder).alias("v")).collect()
    assert v[0].v == v[1].v and abs(math.fsum(x * x for x in v[0].v) - 1) < 1e-9


def test_ties_break_on_the_ordinal(spark):
    df = spark.createDataFrame([("q", f"s{i}", 0.5, i) for i in (2, 0, 1)], "q string, item string, score double, ord int")
    r = ranking.top_gap(df, ["q"], "item", "score", "ord").first()
    assert (r.top1, r.gap) == ("s0", 0.0)
    one = ranking.top_gap(df.where("ord = 2"), ["q"], "item", "score", "ord").first()
    assert (one.top1, one.gap) == ("s2", 0.5)


def test_undecided_rows_only(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    first = lambda d: d.withColumn("_d", F.when(F.col("t") == "x", "a"))
    fails = F.udf(lambda t: t + "!" if t == "y" else 1 / 0, "string")
    second = ranking.only_undecided(lambda d: d.withColumn("_d", fails("t")))
    assert {r.id: r.decision for r in ranking.first_decision(df, [first, second]).collect()} == {1: "a", 2: "y!"}


def test_dictionary(spark):
    terms = spark.createDataFrame(
        [("bgp", "kpi", "protocol", '"bgp"', None, None, 0.9, ["BGP协议"], True), ("ab", "d", "s", None, "e", "E", 2.0, None, None), ("告警", "d", "s", None, None, None, None, [], False), ("x", "d", "s", None, None, None, 0.5, [], False)],
        "term string, domain string, slot string, value string, entity_id string, entity_name string, score double, aliases array<string>, word_boundary boolean",
    )
    texts = spark.createDataFrame([(1, "BGP xbgp ab告警告警"), (2, None), (3, ""), (4, "BGP协议")], "id int, text string")
    found = dictionary.patterns(terms)
    got = sorted((r.id, r.first, r.last, r.folded) for r in dictionary.find_terms(texts, "id", "text", found).collect())
    assert got == [(1, 1, 3, "bgp"), (1, 10, 11, "ab"), (1, 12, 13, "告警"), (1, 14, 15, "告警"), (4, 1, 3, "bgp"), (4, 1, 5, "bgp协议")]
    assert dictionary.find_terms(texts, "id", "text", found, most=2).where("id = 1").count() == 2
    assert dictionary.find_terms(texts, "id", "text", found.limit(0)).count() == 0


def test_dictionary_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_TERMS", 3)
    terms = spark.createDataFrame([(f"t{i:02d}", "d", "s", None, None, None, 1.0, [], False) for i in range(10)], "term string, domain string, slot string, value string, entity_id string, entity_name string, score double, aliases array<string>, word_boundary boolean")
    texts = spark.createDataFrame([(1, " ".join(f"t{i:02d}" for i in range(10)))], "id int, text string")
    assert dictionary.find_terms(texts, "id", "text", dictionary.patterns(terms)).count() == 10


def _many_terms(spark, n=1500, n_texts=60):
    rng = random.Random(5)
    spell = ["ab", "b a", "告警", "ba", "aab", "告b"]
    rows = [(rng.choice(spell), rng.choice(["d1", "d2", None]), rng.choice(["s1", "s2", None]), rng.choice([None, f"v{rng.randrange(400)}"]), rng.choice([None, f"e{rng.randrange(400)}"]), "N", rng.choice([0.5, 0.7, 0.9, None]), rng.choice([None, [rng.choice(spell)]]), rng.choice([True, False, None])) for _ in range(n)]
    terms = spark.createDataFrame(rows, "term string, domain string, slot string, value string, entity_id string, entity_name string, score double, aliases array<string>, word_boundary boolean")
    texts = spark.createDataFrame([(i, "".join(rng.choice(["a", "b", " ", "告警", "c", "AB "]) for _ in range(rng.randrange(30)))) for i in range(n_texts)] + [(-1, None), (-2, "")], "id int, text string")
    return dictionary.patterns(terms), texts


@pytest.mark.parametrize("most_sent", [200_000, 0])
def test_best_values_without_all_matches(spark, monkeypatch, most_sent):
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", most_sent)
    found, texts = _many_terms(spark)
    every, priorities = dictionary.find_terms(texts, "id", "text", found), {"d1": 1.0, "d2": 0.9}
    columns = ("id", "slot", "slot_value", "score", "rank", "domain", "folded", "first")
    rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert rows(dictionary.best_values(texts, "id", "text", found, priorities, 3)) == rows(dictionary.ranked_values(every, "id", priorities, 3))
    places, terms = dictionary.first_matches(texts, "id", "text", found, ["slot"], F.coalesce("value", "entity_id", "folded"), [F.col("score").desc(), F.col("domain")], 3)
    assert terms.count() <= 6 * 3 * 3 * 3  # spellings, kinds of terms, slots, values
    assert dictionary.with_terms(places, "id", terms).count() < every.count() / 10


def test_arbitrated_without_all_matches(spark):
    found, texts = _many_terms(spark)
    asked = texts.withColumn("picked", F.when(F.col("id") % 3 == 0, F.array(F.lit("d1"))).when(F.col("id") % 3 == 1, F.array(F.lit("d2"), F.lit("d1"))))
    lists, priorities = {"s1": ["d1"], "s2": ["d2", "d3"]}, {"d1": 1.0, "d2": 0.9}
    every = domains.matches_by_domain(asked, "id", "text", "picked", found)
    columns = ("id", "slot", "value_", "net", "score", "rank", "domain", "entity_id", "folded", "first")
    rows = lambda df: sorted((tuple(r) for r in df.where("rank <= 3").select(*columns).collect()), key=repr)
    best = domains.best_by_domain(asked, "id", "text", "picked", found, lists, 3)
    got = rows(domains.arbitrated(best, "id", priorities, lists))
    assert got == rows(domains.arbitrated(every, "id", priorities, lists)) and len(got) > 100
    assert best.count() < every.count() / 10


def test_seed_policies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "o int, k string")
    for policy, expected in (("keep_first", {("a", 1, 1), ("b", 2, 2)}), ("keep_last", {("a", 3, 1), ("b", 2, 2)})):
        assert {(r.k, r.o, r.position) for r in seeds.one_per_key(rows, "k", "o", policy).collect()} == expected
    assert seeds.one_per_key(rows, "k", "o", "error").count() == 2
    with pytest.raises(ValueError):
        seeds.one_per_key(rows, "k", "o", "other")


def test_gates(spark):
    runs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None)], "id string, d string")
    assert evaluate.stability(runs, "id", ["d"]).first() == (2, 1, 0.5)
    results = spark.createDataFrame([(True, 1.2), (False, 1.0), (True, None)], "ok boolean, weight double").na.fill(1.0)
    summary = evaluate.accuracy(results)
    evaluate.enforce_gates(summary, {"exact_accuracy": 0.6})
    with pytest.raises(evaluate.GateError):
        evaluate.enforce_gates(summary, {"weighted_accuracy": 0.9})


def test_json_objects_only(spark):
    rows = [('{"a":1}',), ('{"a":1} xyz',), ('{"a":1}{"b":2}',), ("'{\"a\":1}'",), ("[1]",), ("5",), ('"x"',), ('{\\"a\\": 1}',), ("{'a': 'b'}",), ('{“a”: 1}',), ('{"a":1}],[{"b":2}',), (None,), ("",)]
    got = [g[0] for g in values(spark, rows, "t string", text.repaired_json(F.col("t")))]
    assert got == ['{"a":1}', None, None, '{"a":1}', None, None, None, '{"a": 1}', '{"a": "b"}', '{"a": 1}', None, None, None]
    rows = [('```json\n{"a":1}\n```',), ('said {"a":{"b":1}} ok',), ("none",), ('{"a":1} and {"b":2}',), (None,)]
    assert [g[0] for g in values(spark, rows, "t string", text.embedded_json(F.col("t")))] == ['{"a":1}', '{"a":{"b":1}}', None, None, None]


def test_import_of_rows(spark):
    names = "row int, case_id string, scene_id string, label string, text string, enabled string, priority string, slots_json string, tags string, owner string, risk_level string"
    good = ("c1", "s", "l", "text", "on", " 7 ", '{"a":1}', "a, b|c,,", None, "high")
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("case_id", "scene_id", "label", "text", "enabled", "priority", "slots_json", "tags", "owner", "risk_level"), good))
    cases = [(good, None), (change(case_id=" "), "missing_case_id"), (change(text="x"), "short_text"), (change(enabled="maybe"), "bad_enabled"), (change(enabled=""), None), (change(enabled=None), None), (change(priority=""), "bad_priority"), (change(priority="7.5"), "bad_priority"), (change(priority=None), None), (change(slots_json="[1]"), "bad_slots"), (change(slots_json='{"a":1} x'), "bad_slots"), (change(slots_json=""), None)]
    df = seeds.normalized_rows(spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], names), "row")
    got = {r.row: r for r in df.collect()}
    assert [got[i].reason for i in range(len(cases))] == [why for _, why in cases]
    first = got[0]
    assert (first.tags, first.owner, first.risk_level, first.source, first.notes, first.version, first.route_type, first.priority, first.enabled) == (["a", "b", "c"], "", "high", "import", "", "v1", "route_nl2sql", 7, True)
    assert got[4].enabled is False and got[5].enabled is True and got[8].priority == 100 and got[11].slots_json == "{}"
    counts = lambda policy: tuple(seeds.import_counts(df, "case_id", policy).first())
    assert counts("keep_last") == (12, 1, 7, 4, 1) and counts("error") == (12, 1, 11, 4, 1)
    own = spark.createDataFrame([(1, "c", "s", "l", "text", {"x": "1"}, '{"a":1}', ["p", " "])], "row int, case_id string, scene_id string, label string, text string, slots map<string,string>, slots_json string, tags array<string>")
    r = seeds.normalized_rows(own, "row").first()
    assert r.slots_json == '{"x":"1"}' and r.tags == ["p"] and r.reason is None


def test_long_lists_come_in_parts(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    children = spark.createDataFrame([("a", f"x{i:03d}") for i in range(100)] + [("b", "y"), (None, "z"), ("b", None)], "k string, id string")
    rows = seeds.grouped_back(parents, children, "k", "id", most=30).collect()
    assert sorted(x for r in rows if r.k == "a" for x in r.children) == [f"x{i:03d}" for i in range(100)] and sum(r.k == "a" for r in rows) == 4
    assert [r.children for r in rows if r.k == "b"] == [["y"]] and [r.children for r in rows if r.k == "c"] == [[]]


def test_places_over_partitions(spark):
    df = spark.range(1000).selectExpr("hash(id) as h", "id").repartition(5)
    got = ranking.with_places(df, "h", "id").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.h, r.id))] == list(range(1, 1001))


def test_no_temporary_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from switchyard.session import shared_folder

    conf = {}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(fake, "x")
    conf["spark.checkpoint.dir"] = "/shared"
    assert shared_folder(fake, "x") == "/shared"


def test_spread_keeps_the_rows(spark):
    from switchyard.session import spread

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in spread(one).collect()) == list(range(100))
    many = spark.range(100).repartition(64)
    assert spread(many) is many

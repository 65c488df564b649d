from switchyard.llm import dedup as D

ROWS = [
    (5, "seed_a_1", "Top 5, please!", '{"a":1,"b":{"c":[1,2],"d":null}}'),
    (9, "SEED-A-1", "top5 please", '{"b": {"d": null, "c": [1, 2]}, "a": 1.0}'),
    (7, "seed a.1", "“TOP 5 PLEASE”", '{\n "a" : 1 , "b":{"c":[1,2],"d":null}}'),
    (2, "seed_a_1", "top 5 please", '{"a":1,"b":{"c":[2,1],"d":null}}'),
    (3, "seed_a_1", "top 5 please", '{"a":"1","b":{"c":[1,2],"d":null}}'),
    (4, "seed_a_1", "top 5 please", None),
    (6, "seed_a_1", "top 5 please", None),
    (1, "seed_a_1", "top 5 please", "{}"),
    (8, "seed_a_2", "top 5 please", None),
    (10, None, None, None),
    (11, None, None, None),
    (12, "x", "", "not json"),
    (13, "x", " -- ", "not json"),
    (14, "x", "", "not  json"),
    (15, "Straße", "ΣΑΣ", '{"k":"\\u4e2d"}'),
    (16, "STRASSE", "σας", '{"k":"中"}'),
    (17, "long", "x y" * 50_000, "[1]"),
    (18, "long", "X, Y" * 50_000, "[1]"),
]


def frame(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "row_id bigint, case_id string, text string, slots_json string, record string, n_copies int")


def test_copies(spark):
    got = sorted((r.row_id_lo, r.row_id_hi) for r in D.copies(frame(spark), "row_id", ["case_id", "text"], ["slots_json"]).collect())
    assert got == [(4, 6), (5, 7), (5, 9), (10, 11), (12, 13), (15, 16), (17, 18)]


def test_collapsed(spark):
    got = {r.row_id: r.n_copies for r in D.collapsed(frame(spark), "row_id", ["case_id", "text"], ["slots_json"]).collect()}
    assert got[5] == 3 and got[4] == 2 and got[8] == 1 and sum(got.values()) == len(ROWS)


def test_empty_and_hot(spark):
    df = frame(spark)
    assert D.copies(df.limit(0), "row_id", ["case_id", "text"], ["slots_json"]).count() == 0
    hot = spark.range(6000).selectExpr("id as row_id", "if(id % 3 = 0, 'same', concat('c', id)) as case_id", "'t' as text", "'{}' as slots_json")
    got = D.copies(hot, "row_id", ["case_id", "text"], ["slots_json"])
    assert got.count() == 1999 and got.where("row_id_lo <> 0").count() == 0


def test_columns_cannot_run_together(spark):
    df = spark.createDataFrame([(1, "ab", "c", None), (2, "a", "bc", None), (3, "abc", None, None), (4, None, "abc", None)], "row_id bigint, case_id string, text string, slots_json string")
    assert D.copies(df, "row_id", ["case_id", "text"], ["slots_json"]).count() == 0


def test_numbers_count_by_value():
    same = ["15", "15.0", "1.5e1", "150E-1"]
    assert len({tuple(D.field_values('{"t":%s}' % x)) for x in same}) == 1
    differ = ["15", "1.5", '"15"', "150", "-15", "15.0000000000000000001", "true"]
    assert len({tuple(D.field_values('{"t":%s}' % x)) for x in differ}) == len(differ)
    assert D.field_values('{"a":{"x":1,"y":[{"p":1,"q":2}]}}') == D.field_values('{"a":{"y":[{"q":2,"p":1.0}],"x":1}}')


def test_extreme_numbers_keep_their_value():
    long, far = "7" * 20_001, "9" * 21
    differ = [long + "1", long + "2", f"1e{far}", f"2e{far}", f"1e-{far}", "1e" + "1" * 5000, "1e" + "1" * 4999 + "2", "-0", "0"]
    assert len({tuple(D.field_values('{"t":%s}' % x)) for x in differ}) == len(differ)
    for same in ([long + "1", long + "1.0", f"{long[0]}.{long[1:]}1e20001"], [f"1e{far}", f"10e{'9' * 20}8", f"0.1e1{'0' * 21}"], ["1e" + "0" * 6000 + "1", "10"], ["0", "0.0", "0e5"]):
        assert len({tuple(D.field_values('{"t":%s}' % x)) for x in same}) == 1


def test_a_hot_group_is_split(spark):
    """Most rows are copies of one record: the join back is split by the adaptive plan."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).selectExpr("xxhash64(id) as row_id", "if(id % 5 < 4, 'hot', concat('c', id % 5003)) as case_id", "'t' as text", "cast(null as string) as slots_json").repartition(12)
        found = D.copies(rows, "row_id", ["case_id", "text"], ["slots_json"])
        assert len(found.collect()) == 60_000 - rows.select("case_id").distinct().count()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

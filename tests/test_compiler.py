from switchyard.plans import compiler as C

_LISTS = "slot_schema struct<required: array<string>, optional: array<string>>, examples array<string>, keywords array<string>, negative_keywords array<string>"
INTENTS = f"intent_id string, capability_id string, case_id string, label string, text string, enabled boolean, route_type string, tags array<string>, priority int, template_id string, {_LISTS}, template struct<template_id: string, {_LISTS}, enabled: boolean>"
ROWS = [
    ("i1", "a.b", "c1", "L", "T", True, None, None, None, "t0", (["x"], None), ["outer"], ["k"], ["n"], ("t1", (None, ["y"]), [" inner ", ""], [], None, None)),
    ("i2", "a.b", "c2", "L", " ", None, None, None, None, "t2", (["x"], None), ["one", "two"], ["k"], None, None),
    ("i3", "a.b", "c3", "", None, True, None, None, None, None, None, None, None, None, None),
    ("i4", "a.b", " ", "L", "no case", True, None, None, None, "t4", None, ["e"], None, None, None),
    ("i5", "a.b", "c5", "L", "off", True, None, None, None, "t5", None, ["e"], None, None, ("t5", None, None, None, None, False)),
]
CAPS = "capability_id string, description string, flow_type string, router_priority int, entry_phrases array<string>, keywords array<string>, required_slots array<string>, enabled boolean, version string, created_at timestamp, deleted_at timestamp, examples array<string>, recommendations array<map<string, string>>, slot_policy map<string, string>"


def caps(spark):
    return spark.createDataFrame([("a.b", "D", None, None, ["p"], None, None, True, "v1", None, None, ["1", "2", "3", "4"], [{"do": "it"}], {"s": "ask"}), ("c", "", None, None, None, None, None, True, "v1", None, None, None, [], {})], CAPS)


def test_templates(spark):
    got = {r.template_id: r for r in C.templates(spark.createDataFrame(ROWS, INTENTS)).collect()}
    assert set(got) == {"t1", "t2"}
    assert (got["t1"].examples, got["t1"].keywords, got["t1"].negative_keywords, got["t1"].required_slots, got["t1"].optional_slots) == (["inner"], ["k"], ["n"], [], ["y"])
    assert (got["t2"].examples, got["t2"].required_slots, got["t2"].case_id_ref, got["t2"].scene_id) == (["one", "two"], ["x"], "c2", "a.b")


def test_index_documents_of_all_kinds(spark):
    intents = spark.createDataFrame(ROWS, INTENTS)
    got = {(r.kind, r.doc_id, r.template_id, r.text) for r in C.all_index_documents(C.scenes(caps(spark)), C.templates(intents), C.seeds(intents)).collect()}
    assert {x for x in got if x[0] == "scene"} == {("scene", "a.b_0", None, "D"), ("scene", "a.b_1", None, "p")}
    assert {x for x in got if x[0] == "template"} == {("template", "t1_0", "t1", "inner"), ("template", "t1_1", "t1", "k"), ("template", "t2_0", "t2", "one"), ("template", "t2_1", "t2", "two"), ("template", "t2_2", "t2", "k")}
    assert {x for x in got if x[0] == "seed"} == {("seed", "c1", "t1", "T"), ("seed", "c2", "t2", "one"), ("seed", "c3", None, "c3"), ("seed", "c5", "t5", "off")}


def test_cases_policies_and_legacy(spark):
    assert [tuple(r) for r in C.cases(caps(spark)).collect()] == [("case_a_b", "a.b", ["1", "2", "3"], [{"do": "it"}])]
    defaults = spark.createDataFrame([({"*": "skip"},)], "slot_policy map<string, string>")
    assert {(r.scene_id, *r.slot_policy.items()) for r in C.slot_policies(caps(spark), defaults).collect()} == {("a.b", ("s", "ask")), (None, ("*", "skip"))}
    legacy = spark.createDataFrame([("t1", "a.b", ["old"]), ("t1", "c", ["other scene"]), ("t9", "a.b", ["new"]), (" ", "a.b", ["blank"])], "template_id string, scene_id string, examples array<string>")
    assert {(r.template_id, r.scene_id, *r.examples) for r in C.with_legacy(C.templates(spark.createDataFrame(ROWS, INTENTS)), legacy, "template_id").collect()} == {("t1", "a.b", "inner"), ("t2", "a.b", "one", "two"), ("t1", "c", "other scene"), ("t9", "a.b", "new")}

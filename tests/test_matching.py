from switchyard.operators import matching as M

SLOTS = "map<string, string>"


def test_scenes_of_flow(spark):
    scenes = spark.createDataFrame([("a", "query"), ("b", " Report"), ("c", None)], "scene_id string, flow_type string")
    asked = spark.createDataFrame([(1, "query"), (2, "report"), (3, "order"), (4, None)], "id int, flow_type string")
    got = {(r.id, r.scene_id, r._d) for r in M.scenes_of_flow(asked, scenes).collect()}
    assert got == {(1, "a", None), (1, "c", None), (2, "b", None), (3, None, "refuse:unsupported_domain"), (4, "a", None), (4, "b", None), (4, "c", None)}


def test_with_scene(spark):
    scenes = spark.createDataFrame([("a", ["t", "m"], {"t": "today", "m": "cpu"}), ("b", None, None)], f"scene_id string, required_slots array<string>, defaults {SLOTS}")
    asked = spark.createDataFrame([(1, "a", {"t": "now", "m": ""}), (2, "zz", {"t": "x"}), (3, "b", None), (4, None, {})], f"id int, scene_id string, slots {SLOTS}")
    got = {r.id: (r.slots, r.required_slots) for r in M.with_scene(asked, scenes).collect()}
    assert got == {1: ({"t": "now", "m": "cpu"}, ["t", "m"]), 2: ({"t": "x"}, []), 3: ({}, []), 4: ({}, [])}


def test_best_templates(spark):
    templates = spark.createDataFrame(
        [("t1", "a", ["cpu"], [], None, ["m"], []), ("t2", "a", ["cpu"], [], ["photo"], [], []), ("t3", "b", ["cpu"], [], None, [], []), ("t4", "a", [], None, [], ["x"], ["m"])],
        "template_id string, scene_id string, keywords array<string>, examples array<string>, negative_keywords array<string>, required_slots array<string>, optional_slots array<string>",
    )
    asked = spark.createDataFrame([(1, "a", "cpu load", {"m": "1"}), (2, "a", "cpu photo", {}), (3, "none", "cpu", {})], f"id int, scene_id string, norm string, slots {SLOTS}")
    hits = spark.createDataFrame([(1, "t4", 0.9), (1, "t4", 0.5), (1, "t3", 1.0), (2, "t2", 0.2)], "id int, template_id string, score double")
    got = {(r.id, r["rank"]): (r.template_id, round(r.score, 6)) for r in M.best_templates(asked, templates, hits, "id", "norm", 3).collect()}
    assert got == {(1, 1): ("t1", 0.55), (1, 2): ("t2", 0.55), (1, 3): ("t4", 0.445), (2, 1): ("t1", 0.35), (2, 2): ("t2", 0.29), (2, 3): ("t4", 0.0)}

import json
import time

import pytest
from pyspark.sql import functions as F

from switchyard.sources import readers, services, sinks
from switchyard.streaming import windows

SCHEMA = "case_id string, text string, tags string"


def test_formats(spark, tmp_path):
    rows = [{"case_id": "a", "text": "l1\nl2", "tags": "x|y"}, {"case_id": "b", "text": 'q"q', "tags": None}]
    (tmp_path / "r.json").write_text(json.dumps(rows), "utf-8")
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n{bad\n", "utf-8")
    (tmp_path / "r.csv").write_text('﻿case_id,text,tags\na,"l1\nl2",x|y\nb,"q""q",\n', "utf-8")
    for name in ("r.json", "r.csv"):
        got = readers.read_rows(spark, str(tmp_path / name), SCHEMA).orderBy("case_id").collect()
        assert [(r.case_id, r.text, r.tags or None) for r in got] == [("a", "l1\nl2", "x|y"), ("b", 'q"q', None)]
    got = readers.read_rows(spark, str(tmp_path / "r.jsonl"), SCHEMA)
    assert sorted((r.line_no, r.case_id, r.reason) for r in got.collect()) == [(1, "a", None), (3, "b", None), (4, None, "invalid_json")]
    with pytest.raises(ValueError, match="line 4"):
        readers.require_lines(got)
    (tmp_path / "l.jsonl").write_text("\n".join(["{}", "[1]", "5", '{"case_id": "z"}']), "utf-8")
    assert [r.reason for r in readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), SCHEMA).orderBy("line_no").collect()] == [None, "not_object", "not_object", None]
    with pytest.raises(ValueError):
        readers.detect_format("x.txt")


def test_terms(spark, tmp_path):
    payload = {"terms": [{"term": " a "}], "domains": {"d": [{"term": "b", "slot_name": "s", "slot_value": "v", "score": 7, "word_boundary": "yes"}, {"term": " "}]}}
    (tmp_path / "t.json").write_text(json.dumps(payload))
    terms = readers.resolve_terms({"dictionary_path": str(tmp_path / "t.json")})
    got = {r.term: r for r in readers.term_rows(spark, terms).collect()}
    assert set(got) == {"a", "b"} and got["a"].domain == "default" and got["a"].word_boundary is None
    assert (got["b"].domain, got["b"].slot, got["b"].value, got["b"].score, got["b"].word_boundary) == ("d", "s", "v", 1.0, True) and got["a"].score == 0.99 and got["a"].ord < got["b"].ord
    assert readers.resolve_terms({"terms": [{"term": "z"}], "dictionary_path": "none"}) == [{"term": "z"}] and readers.resolve_terms({"dictionary_path": "none"}) == []


def test_cases_and_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "text": "t", "expected": {"type": "clarify"}, "role": " "}, {"id": " ", "text": "t"}, {"id": "3", "text": "t", "expected": {"type": "x"}, "tags": "no list"}, {"id": "4", "text": " t", "expected": {"type": "x"}, "tags": ["a"]}]))
    got = readers.benchmark_cases(spark, str(tmp_path / "c.json")).orderBy("id").collect()
    assert [(r.id, r.reason, r.tags) for r in got] == [(" ", "id", None), ("1", None, None), ("3", "tags", None), ("4", None, ["a"])] and got[1].role is None and got[1].weight == 1.0 and got[3].text == " t"
    assert readers.capability_list([1]) == ([1], {}) and readers.capability_list({"capabilities": [], "slot_policy_defaults": {"a": 1}}) == ([], {"a": 1})
    with pytest.raises(ValueError):
        readers.capability_list({})
    assert readers.resolve_backend("ES") == "elasticsearch" and readers.resolve_backend(None, None, " table ") == "table"
    with pytest.raises(ValueError):
        readers.resolve_backend("other")
    assert readers.single_request(spark, {"input_text": "x"}).count() == 1
    for bad in ({}, {"input_text": 5}, {"input_text": "x", "other": 1}):
        with pytest.raises(ValueError):
            readers.single_request(spark, bad)
    assert readers.health(spark, "no_such_table") == {"status": "unavailable", "missing": ["no_such_table"]} and readers.health(spark)["status"] == "ok"
    df = spark.createDataFrame([("a", "s", None), ("b", "s", False), ("c", "t", True)], "id string, scene_id string, enabled boolean")
    assert [r.id for r in readers.by_scene(df, "s").collect()] == ["a"] and readers.by_id(df, "id", "c").count() == 1
    assert readers.existing_terms(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "id string, scene_id string, template_id string, text string, metadata string, vector array<float>")
    path = str(tmp_path / "index")
    assert sinks.ensure_index(spark, path, 2).count() == 0
    assert sinks.bulk_upsert(spark, path, docs([(f"a{i}", "s", None, "t", None, [1.0, 2.0]) for i in range(200)]), 2).count() == 200
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    two = sinks.bulk_upsert(spark, path, docs([("a7", "s", None, "new", None, [3.0, 4.0]), ("b", "s", None, "new", None, [3.0, 4.0])]), 2)
    got = {r.id: r.text for r in two.collect()}
    assert len(got) == 201 and got["a7"] == got["b"] == "new" and got["a8"] == "t"
    kept = sum(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    assert kept >= len(before) - 2  # the parts that the upsert does not touch stay as they are
    with pytest.raises(ValueError):
        sinks.ensure_index(spark, path, 3)
    assert [r.id for r in readers.scan_index(spark, path, 1, 1).collect()] == ["a1"]
    summary = spark.createDataFrame([(0.5, 2)], "exact_accuracy double, total int")
    assert sinks.write_summary(summary, str(tmp_path / "r" / "s.json"), {"exact_accuracy": 0.5}) == {"exact_accuracy": 0.5, "total": 2}
    with pytest.raises(RuntimeError):
        sinks.write_summary(summary, str(tmp_path / "r" / "t.json"), {"exact_accuracy": 0.6})
    assert json.loads((tmp_path / "r" / "t.json").read_text())["total"] == 2
    df = spark.createDataFrame([(1, None), (2, "bad")], "k int, reason string")
    sinks.write_split(df, str(tmp_path / "ok"), str(tmp_path / "no"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "no")).first().reason == "bad"
    assert sinks.write_pretty(df, str(tmp_path / "p" / "x.json"), ["k"]) == 2 and json.loads((tmp_path / "p" / "x.json").read_text())[1] == {"k": 2, "reason": "bad"}


def test_services(spark):
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert services.with_retry(flaky, 2, 0.2, slept.append) == "ok" and slept == [0.2, 0.4]
    assert services.walk_path({"a": [{"b": 1}]}, "a.0.b") == 1 and services.walk_path({"a": []}, ["a", "1"]) is None

    def make():
        def transport(request):
            if "boom" in request["input"]:
                raise TimeoutError
            return json.dumps({"choices": [{"message": {"content": request["input"].upper()}}]})

        return transport

    df = spark.createDataFrame([(1, "x", True), (2, "boom", True), (3, "y", False), (4, None, None)], "id int, t string, unsure boolean")
    got = {r.id: (r.answer, r.answer_error) for r in services.ask_model(df, "t", "unsure", make, retries=0).collect()}
    assert got == {1: ("X", None), 2: (None, "TimeoutError"), 3: (None, None), 4: (None, None)}
    u = spark.createDataFrame([(0.9, 0.1), (0.9, 0.85), (0.2, 0.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in u.select(services.needs_model(F.col("a"), F.col("b"), True, 0.3, 0.08, False)).collect()] == [False, True, False, False]


def test_stream_batches_and_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s1", "a=1"), ("s1", "a=2,b=3"), ("s2", "c=4")], "session string, slots string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session string, slots string").parquet(src)
    seen = []
    windows.run_available(stream, str(tmp_path / "c1"), each=lambda df, n: seen.append(df.count()))
    assert sum(seen) == 3
    query = windows.session_slots(stream, "session", "slots").writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        # State with a time-out keeps its stream at work, so the test waits for rows and not for an end.
        for _ in range(120):
            last = {r.session: (r.turns, r.slots) for r in spark.table("sessions").collect()}
            if len(last) == 2:
                break
            time.sleep(0.25)
    finally:
        query.stop()
    assert last["s1"][0] == 2 and last["s1"][1].endswith("b=3") and last["s2"] == (1, "c=4")


def test_search_clients(spark, tmp_path):
    from switchyard.sources import search

    docs = [("d1", "s", "bgp flap", [1.0, 0.0]), ("d2", "t", "bgp", [0.9, 0.1]), ("d3", "s", "cpu", [0.0, 1.0])]
    spark.createDataFrame(docs, "id string, scene_id string, text string, vector array<double>").write.parquet(str(tmp_path / "ix"))
    client = search.build_client(spark, "table", str(tmp_path))
    assert search.ready(client, "ix") and not search.ready(client, "none")
    asked = spark.createDataFrame([("q", "bgp flap", [1.0, 0.0])], "q string, t string, v array<double>")
    assert [r.doc_id for r in client.text("ix", asked, "q", "t", {"text": 2.0}, 5).orderBy("rank").collect()] == ["d1", "d2"]
    assert [r.doc_id for r in client.vector("ix", asked, "q", "v", 2, "s").orderBy("rank").collect()] == ["d1", "d3"]

    def make():
        def transport(path, body):
            if path == "/none":
                return json.dumps({"error": 404})
            if body and "boom" in json.dumps(body):
                raise OSError
            return json.dumps({"hits": {"hits": [{"_id": "d9", "_score": 1.5}, {"_id": "d8", "_score": None}]}})

        return transport

    http = search.build_client(spark, "es", make_transport=make)
    assert search.ready(http, "ix") and not search.ready(http, "none")
    two = spark.createDataFrame([(1, "x"), (2, "boom")], "q int, t string")
    got = sorted(map(tuple, http.text("ix", two, "q", "t", {"text": 1}, 5).collect()), key=str)
    assert got == [(1, "d8", 0.0, 2, None), (1, "d9", 1.5, 1, None), (2, None, None, None, "OSError")]
    assert search.search_body("x", {"name": 3, "aliases": 1}, 2, "s") == {"size": 2, "query": {"bool": {"must": [{"multi_match": {"query": "x", "fields": ["name^3", "aliases"]}}], "filter": [{"term": {"scene_id": "s"}}]}}}
    with pytest.raises(ValueError):
        search.build_client(spark, "opensearch")


def test_embedders():
    from switchyard.functions import scoring

    answer = lambda request: json.dumps({"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}][: len(request["input"])]})
    encode = scoring.make_embedder({"provider": "http", "model": "m", "dimension": 2}, make_transport=lambda: answer)()
    assert encode(["a", "b"]).tolist() == [[1, 0], [0, 1]] and encode([]).shape == (0, 2)
    with pytest.raises(ValueError):
        scoring.make_embedder({"provider": "http", "model": "m", "dimension": 3}, make_transport=lambda: answer)()(["a", "b"])

    class Model:
        def encode(self, texts):
            return [[len(t)] for t in texts]

    assert scoring.make_embedder({"provider": "local"}, load=Model)()(["abc"]).tolist() == [[3.0]]
    with pytest.raises(ValueError):
        scoring.make_embedder({"provider": "local"})


def test_model_input_is_cut_openly(spark):
    df = spark.createDataFrame([(1, "x" * 900, True), (2, "y", True), (3, "z" * 900, False)], "id int, t string, unsure boolean")
    make = lambda: lambda request: json.dumps({"choices": [{"message": {"content": str(len(request["input"]))}}]})
    got = lambda most: {r.id: (r.answer, r.answer_cut) for r in services.ask_model(df, "t", "unsure", make, most_chars=most).collect()}
    assert got(600) == {1: ("600", True), 2: ("1", False), 3: (None, False)} and got(None)[1] == ("900", False)


def test_command_line(spark, tmp_path, capsys):
    from switchyard import cli

    queries = {"two": lambda s, d: s.range(2)}
    assert cli.main(["list"], queries) == 0 and "two" in capsys.readouterr().out
    assert cli.main(["run", "none", "--data", "x"], queries) == 2
    assert cli.main(["run", "two", "--data", "x", "--out", str(tmp_path / "o")], queries) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 2
    assert cli.main(["run", "two", "--data", "x", "--show", "1"], queries) == 0

import csv
import io
import random

from switchyard.operators import rawload

N = len(rawload.SEED_COLUMNS)
GOOD = ["seed_1", "s.c", "l", "some text", "route", '{"a": {"b": 1}}', "x|y", "100", "o", "v1", "true", "low", "src", "note"]


def line(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    return out.getvalue()


def machine(s):
    """Fields by a character machine, or the failure."""
    if s is None:
        return None, "columns"
    fields, i = [], 0
    while True:
        value = ""
        if i < len(s) and s[i] == '"':
            i += 1
            while True:
                if i >= len(s):
                    return None, "quoting"
                if s[i] == '"' and s[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                elif s[i] == '"':
                    i += 1
                    break
                else:
                    value, i = value + s[i], i + 1
            if i < len(s) and s[i] != ",":
                return None, "quoting"
        else:
            while i < len(s) and s[i] != ",":
                if s[i] == '"':
                    return None, "quoting"
                value, i = value + s[i], i + 1
        fields.append(value)
        if i >= len(s):
            return fields, None if len(fields) == N else "columns"
        i += 1


def test_machine_agrees(spark):
    rng = random.Random(5)
    lines = [line(GOOD), "", None, ",".join(["a"] * N), line(GOOD) + ',"', '"' + line(GOOD)]
    for _ in range(1500):
        s = list(line([rng.choice(["", "a", 'q"q', "x,y", "l\nm", "\u0001\u0002", "好"]) for _ in range(rng.choice([N, N, N, N - 1, N + 1]))]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            s.insert(rng.randrange(len(s) + 1), rng.choice(['"', '""', ",", "z"]))
        lines.append("".join(s))
    lines = [x if x is None else x.rstrip("\r\n") for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "k bigint, raw string")
    got = {r.k: (list(r[2:]) if r.structure is None else None, r.structure) for r in rawload.parse_records(df, "k", "raw").collect()}
    for k, x in enumerate(lines):
        fields, why = machine(x)
        assert got[k] == (None if why else fields, why), x


def test_reasons_and_values(spark):
    def case(**change):
        row = dict(zip(rawload.SEED_COLUMNS, GOOD)) | change
        return line([row[c] for c in rawload.SEED_COLUMNS])

    cases = [
        (case(), None), (case(case_id=" seed.1-a_B "), None), (case(case_id=""), "case_id"), (case(case_id="a b"), "case_id"), (case(case_id="x" * 65), "case_id"), (case(case_id="é"), "case_id"), (case(case_id="ok\n"), None),
        (case(slots_json=""), None), (case(slots_json="  "), None), (case(slots_json="[]"), "slots_json"), (case(slots_json="null"), "slots_json"), (case(slots_json="{}{}"), "slots_json"), (case(slots_json="{'a':1}"), "slots_json"),
        (case(slots_json='{"a":NaN}'), "slots_json"), (case(slots_json='{"a":1,}'), "slots_json"), (case(slots_json=' {"a":[1,2]} '), None), (case(case_id="?", slots_json="["), "case_id"), (case(notes='say "hi"\nthere'), None),
        (line(GOOD[:-1]), "columns"), (line([*GOOD, "x"]), "columns"), (line(GOOD) + '"', "quoting"), (line(GOOD) + "\r\n", None), (case(text="t" * 200_000), None), ('"' * 20_001, "quoting"), (case(slots_json='{"k":"' + '\\"' * 20_000 + '"}'), None),
    ]
    df = spark.createDataFrame([(i, s, "clash") for i, (s, _) in enumerate(cases)] + [(99, cases[2][0], "")], "k bigint, raw string, case_id string")
    got = {r.k: r.reason for r in rawload.rejected(df, "k", "raw").collect()}
    assert got == {i: why for i, (_, why) in enumerate(cases) if why} | {99: "case_id"}
    loaded = {r.k: r for r in rawload.loaded(df, "k", "raw").collect()}
    assert set(loaded) == {i for i, (_, why) in enumerate(cases) if not why}
    assert loaded[0].priority == 100 and loaded[0].enabled is True and loaded[1].case_id == "seed.1-a_B" and loaded[7].slots_json is None
    assert rawload.rejected(df.limit(0), "k", "raw").count() == 0


def test_large_dictionary_is_joined(spark, monkeypatch):
    monkeypatch.setattr(rawload, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, line(["bad id", *GOOD[1:]]) if i % 2 else line(GOOD)) for i in range(20)], "k bigint, raw string")
    assert {r.k for r in rawload.rejected(df, "k", "raw").collect()} == set(range(1, 20, 2))


def test_json_of_any_depth_and_length():
    deep = '{"a":' * 60_000 + "[1]" + "}" * 60_000
    assert rawload.is_strict_json_object(deep) and not rawload.is_strict_json_object(deep[:-1]) and not rawload.is_strict_json_object(deep + "}")
    assert rawload.is_strict_json_object('{"a": ' + "7" * 5000 + "}") and not rawload.is_strict_json_object('{"a": ' + "0" + "7" * 5000 + "}")
    for text in ('{}', ' {"a":[]}\n', '{"a":[1,{"b":null}],"c":"\\u00e9"}', '[]', '{"a":1,}', '{"a" 1}', '{,}', '{"a":[1,]}', '{"a":1}{}', '{"a":1} x', '{"a":NaN}', '{"a":01}', '{"a":"\x01"}', '"x"', '', '{"a":}', '{"a":1]', '{1:2}', '{"a":[}', '{"a":1 "b":2}', '{"a":tru}', '{"a":-}', '{"a":1.}', "{'a':1}"):
        assert rawload._is_object_by_tokens(text) == rawload.is_strict_json_object(text), text


def test_dictionary_by_value_spreads_hot_values(spark, monkeypatch):
    """Beyond the bounds for sending the same rows come out, with a third of all records sharing one bad value."""
    good = ["c1", "s", "l", "t", "r", '{"a":1}', "", "1", "o", "v", "true", "low", "x", ""]
    line = lambda **k: ",".join('"' + k.get(c, g).replace('"', '""') + '"' for c, g in zip(rawload.SEED_COLUMNS, good))
    lines = [line(case_id="") if i % 3 == 0 else line(slots_json="[1]") if i % 7 == 0 else "x,y" if i % 5 == 0 else line() for i in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string")
    sent = sorted(map(tuple, rawload.rejected(df, "line_id", "raw_line").collect()))
    monkeypatch.setattr(rawload, "_may_be_sent", lambda d: False)
    assert sent and sorted(map(tuple, rawload.rejected(df, "line_id", "raw_line").collect())) == sent
    assert rawload.loaded(df, "line_id", "raw_line").count() == 600 - len(sent)


def test_large_values_are_not_sent(spark, monkeypatch):
    """Few invalid values of many bytes go beyond the bound in bytes; the rows are the same."""
    rows = [(i, line(["x" * 300 + str(i % 3), *GOOD[1:]]) if i % 2 else line(GOOD)) for i in range(30)]
    df = spark.createDataFrame(rows, "k bigint, raw string")
    sent = sorted(map(tuple, rawload.rejected(df, "k", "raw").collect()))
    assert len(sent) == 15
    monkeypatch.setattr(rawload, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, rawload.rejected(df, "k", "raw").collect())) == sent

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from switchyard.operators.packed import explode_packed, tokenize_packed

CASES = [
    (None, []),
    ("", []),
    ("  \t ", []),
    ("one", ["one"]),
    ("a|b;c，d、e｜f；g", ["a", "b", "c", "d", "e", "f", "g"]),
    ("a||b, ,c;", ["a", "b", "c"]),
    ('x;"R&D, lab";in/out;night shift', ["x", "R&D, lab", "in/out", "night shift"]),
    ("'a|b'|c", ["a|b", "c"]),
    ("“上联，下联”，x", ["上联，下联", "x"]),
    ('"ring ""A"""|y', ['ring "A"', "y"]),
    ('["a","b, c"]', ["a", "b, c"]),
    (' [a|b] ', ["a", "b"]),
    ("[a]|[b]", ["[a]", "[b]"]),
    ('["]","x"]', ["]", "x"]),
    ("{[a;b]}", ["a", "b"]),
    ('"never closed, b', ['"never closed', "b"]),
    ("it's|won't", ["it's", "won't"]),
    ('""|a', ["a"]),
    ('" x "', ["x"]),
    (r'["say \"hi\"","b"]', ['say "hi"', "b"]),
    ("a|a|a", ["a", "a", "a"]),
    ("tcp/ip v2.1 sev:high R&D loss_rate top-10", ["tcp/ip v2.1 sev:high R&D loss_rate top-10"]),
]


@pytest.mark.parametrize("field,values", CASES)
def test_cases(field, values):
    assert tokenize_packed(field) == values


VALUES = st.text(alphabet='ab c-/.:&_,;|、"', min_size=1, max_size=8).map(str.strip).filter(lambda x: x and x[0] not in '"')


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_round_trip(values, rng: random.Random):
    """Quoted values joined by any separators come back as they were."""
    quoted = ['"' + v.replace('"', '""') + '"' for v in values]
    field = quoted[0] + "".join(rng.choice([",", ";", "|", "，", "、", "\t", " | "]) + q for q in quoted[1:])
    assert tokenize_packed(field) == values


def test_operator(spark):
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "y"), (2, None, "z"), (3, "", None), (4, "v" * 50_000 + "|w", "")], "row_id bigint, tags string, tag string")
    got = explode_packed(df, "tags", "row_id")
    assert got.columns == ["row_id", "pos", "tag"]
    assert sorted((r.row_id, r.pos, len(r.tag)) for r in got.collect()) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (4, 1, 50_000), (4, 2, 1)]
    assert explode_packed(df.limit(0), "tags", "row_id").count() == 0

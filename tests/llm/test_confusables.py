import unicodedata

from switchyard.llm import confusables as C

SAME = [
    ("Sandriva", "Ｓａｎｄｒｉｖａ"), ("Sandriva", "Ѕаndrіvа"), ("Çelbara", "Çelbara"), ("a b", "a b"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "﻿a­b️"),
    ("石", "⽯"), ("长门", "⻓⻔"), ("路", "路"), ("ポンゴ", "ﾎﾟﾝｺﾞ"), ("μs", "µs"), ("a,b", "a，b"), ("BS-QN", "ΒЅ-QΝ"),
]
DIFFERENT = [("ab", "AB"), ("a b", "ab"), ("a  b", "a b"), ("a-b", "a b"), ("a-b", "ab"), ("m²", "m2"), ("网", "網"), ("e", "é"), ("a,b", "a.b")]


def skel(x):
    return C.skeleton(x, C.look_alikes(), C._width_table())


def test_pairs_of_texts(spark):
    for a, b in SAME:
        assert skel(a) == skel(b), (a, b)
    for a, b in DIFFERENT:
        assert skel(a) != skel(b), (a, b)


def test_letters_and_digits(spark):
    form = lambda x: C.letters_and_digits(x, C.case_keeping(), C._width_table())
    assert form("ІNC-7 ｂS!") == form("inc7bs") == "inc7bs"
    assert form("Éa") == form("ÉA") and len(form("é")) == 1
    assert form(" -！") == ""


def test_operator_against_brute_force(spark):
    texts = [x for p in SAME + DIFFERENT for x in p] + ["", " ", "  ", None, None, "ab", "ab", "x" * 30_000, "х" * 30_000]
    rows = [(f"r{i:03d}", t, "clash", "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string, skel string, form string")
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and skel(a[1]) == skel(b[1])}
    got = [tuple(r) for r in C.look_alike_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    forms = {r.id: r.consistent for r in C.consistent_texts(df, "text").collect()}
    assert forms[rows[0][0]] == forms[rows[1][0]] and unicodedata.is_normalized("NFC", forms[rows[0][0]])
    assert C.look_alike_pairs(df.limit(0), "id", "text").count() == 0
    assert C.look_alike_classes(df, "id", "text").count() > 5


def test_hot_form_is_not_compared_with_itself(spark):
    df = spark.range(3000).selectExpr("concat('r', lpad(id, 5, '0')) id", "if(id = 7, 'hоt', 'hot') text")
    got = C.look_alike_pairs(df, "id", "text")
    assert got.count() == 2999


def test_character_tables_agree_with_whole_texts(spark):
    """The fast way gives what the functions on whole texts give, joining characters or not."""
    import random
    import unicodedata

    rng = random.Random(3)
    pool = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    joining = [c for c in pool if unicodedata.category(chr(c))[0] == "M"] + list(range(0x1100, 0x1200))
    texts = ["".join(chr(rng.choice(joining if rng.random() < 0.2 else pool)) for _ in range(rng.randint(0, 6))) for _ in range(20_000)]
    width, table, letters = C._width_table(), C.look_alikes(), C.case_keeping()
    for name, f in (("test skeleton", lambda t: C.skeleton(t, table, width)), ("test letters", lambda t: C.letters_and_digits(t, letters, width))):
        fast = C._fast(name, f)
        assert [fast(t) for t in texts] == [f(t) for t in texts]


def test_members_are_the_pairs_in_compact_form(spark):
    texts = [x for p in SAME + DIFFERENT for x in p] * 2
    df = spark.createDataFrame([(f"r{i:03d}", t) for i, t in enumerate(texts)], "id string, text string")
    pairs = [tuple(r) for r in C.look_alike_pairs(df, "id", "text").collect()]
    members = {r.id: r for r in C.look_alike_members(df, "id", "text").collect()}
    assert set(members) == {x for p in pairs for x in p}
    assert all(members[a].class_id == members[b].class_id for a, b in pairs)
    assert all(m.n_links == sum(m.id in p for p in pairs) for m in members.values())

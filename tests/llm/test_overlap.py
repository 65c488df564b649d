import random

import numpy as np

from switchyard.llm import overlap as O


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abcdefgh12345"))
        elif s:
            i = min(i, len(s) - 1)
            if kind == 1:
                s[i] = rng.choice("abcdefgh12345")
            else:
                del s[i]
    return "".join(s)


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh12345") for _ in range(n)) for n in (1, 5, 9, 10, 11, 19, 20, 30, 47, 54, 63, 64, 72, 80, 99, 100, 130)]
    base += ["aaaa" * 9, "ab" * 40, "共享模板前缀" + "".join(rng.choice("abcdef") for _ in range(30))]
    evals, trains = [], []
    for b in base:
        k = len(b) // 10
        trains += [b, b]
        evals += [b, *(edited(rng, b, n) for n in (k, k, max(0, k - 1), k + 1, k + 2))]
    return evals, trains


def test_no_pair_is_lost(spark):
    evals, trains = corpus()
    e = [(f"e{i:03d}", t, "src", "golden") for i, t in enumerate(evals)] + [("e900", None, "s", "g"), ("e901", " -! ", None, "g"), ("e902", "", "s", "g")]
    t = [(f"t{i:03d}", x, "clash") for i, x in enumerate(trains)] + [("t900", None, ""), ("t901", "--", ""), ("t902", "", "")]
    ed = spark.createDataFrame(e, "id string, text string, source string, split string")
    td = spark.createDataFrame(t, "id string, text string, form string").drop("form")
    pairs = O.overlaps(ed, td)
    got = [(r.eval_id, r.intent_id, r.edits) for r in pairs.collect()]
    expected = {(a, b, d) for a, x, *_ in e for b, y, *_ in t if x and y and x.strip(" -!") and y.strip("-") and (d := distance(x, y)) <= max(len(x), len(y)) // 10}
    assert len(got) == len(set(got)) and set(got) == expected
    report = {r.split: r for r in O.overlap_report(ed, pairs).collect() if r.source == "src"}
    assert report["golden"].n_records == len(evals) and report["golden"].n_pairs == len(got)
    assert O.overlaps(ed.limit(0), td).count() == 0 and O.overlaps(ed, td.limit(0)).count() == 0


def test_fingerprints_keep_within_their_radius():
    rng = random.Random(2)
    for n in (12, 50, 100, 300):
        a = "".join(rng.choice("abcdefgh12345") for _ in range(n))
        for k in (1, 3, n // 10):
            b = edited(rng, a, k)
            codes = O.Codes([a, b])
            for side in (codes.start[:2], codes.start[1:]):  # an empty block at the begin, then at the end
                begin = np.minimum(side, codes.start[1:] - 1)
                x, y = codes.sides(begin, side) if side is codes.start[:2] else codes.sides(begin, begin + 1)
                flips = [bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y)]
                assert sum(flips) <= 4 * k + 4


def test_blocks_are_disjoint_enough_and_cheap():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh12345") for _ in range(n)) for n in (9, 10, 17, 18, 40, 71, 72, 80, 300, 1300)] + ["a" * 500]
    counts = O.window_counts([t + "common part of all" for t in texts], 1 << 16).astype(float)
    codes = O.Codes(texts)
    sizes = {(int(i), int(h)): s for s, hs in codes.windows() for i, h in enumerate(hs)}
    owner, place, h, _ = O.chosen_blocks(codes, counts)
    for i, t in enumerate(texts):
        at = sorted((int(p), sizes[int(codes.start[i] + p), int(x)]) for p, x in zip(place[owner == i], h[owner == i]))
        assert len(at) == O.most_edits(len(t)) + 1
        assert all(p + s <= q for (p, s), (q, _) in zip(at, at[1:])) and at[-1][0] + at[-1][1] <= len(t)


def test_tables_of_any_size_give_the_same(spark):
    """Collisions in the two tables cost time only."""
    evals, trains = corpus()
    frame = lambda ts: O.materialize(O._classes(O._forms(spark.createDataFrame([(str(i), t) for i, t in enumerate(ts)], "id string, text string"))))
    a, b = frame(evals), frame(trains)
    pairs = lambda **sizes: {tuple(map(bytes, r[:2])) for r in O.near_classes(a, b, **sizes)[0].collect()}
    some = pairs()
    assert some and some == pairs(counters=64, bits=1 << 15)


def test_long_texts(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh12345") for _ in range(9000))
    ed = spark.createDataFrame([("e1", edited(rng, a, 700), "s", "g")], "id string, text string, source string, split string")
    td = spark.createDataFrame([("t1", a), ("t2", a[::-1])], "id string, text string")
    assert [(r.eval_id, r.intent_id) for r in O.overlaps(ed, td).collect()] == [("e1", "t1")]


def test_repeats_within_a_text(spark):
    """Blocks that occur many times in their text are kept as ranges and still found."""
    rng = random.Random(4)
    a = "abcdefgh" * 60 + "xyz"
    ed = spark.createDataFrame([(f"e{i}", edited(rng, a, 40), "s", "g") for i in range(4)], "id string, text string, source string, split string")
    td = spark.createDataFrame([("t1", a), ("t2", "abcdefgh" * 61)], "id string, text string")
    texts = {r.id: r.text for r in ed.select("id", "text").union(td).collect()}
    expected = {(x, y) for x in texts for y in texts if x[0] == "e" and y[0] == "t" and distance(texts[x], texts[y]) <= max(len(texts[x]), len(texts[y])) // 10}
    assert expected and {(r.eval_id, r.intent_id) for r in O.overlaps(ed, td).collect()} == expected


def test_counts_change_by_two_an_edit():
    rng = random.Random(6)
    for n in (12, 90, 400):
        a = "".join(rng.choice("abcdefgh12345共享") for _ in range(n))
        for k in (0, 1, 5):
            x, y = O.bag_words(O.Codes([a, edited(rng, a, k)]))
            assert sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y)) <= 2 * k

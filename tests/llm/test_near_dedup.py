from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablewright.llm.graph import components
from tablewright.llm.near_dedup import Likeness, drop_near, near_groups, shingle_set


def by_hand(docs, width, percent):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    reach = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(reach[a], reach[b])
            if reach[a] != low or reach[b] != low:
                reach[a] = reach[b] = low
                changed = True
    return sorted((i, len(sets[i]), reach[i], reach[i] == i) for i in ids)


def corpus(seed, n=120):
    random.seed(seed)
    words = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 4))) for _ in range(300)]
    line = " ".join(random.choices(words, k=12))
    bases = [random.choices(words, k=random.choice([3, 5, 30, 120])) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "Éa b"), (6, "éa b")]
    for i in range(7, n):
        own = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 4, 12])):
            own[random.randrange(len(own))] = random.choice(words)
        docs.append((i, (line + " " if random.random() < 0.4 else "") + " ".join(own)))
    return docs


def test_components_are_those_of_all_pairs(spark):
    for seed, how in ((1, Likeness(words=4)), (2, Likeness()), (3, Likeness(words=2, k=16, overlap=4))):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_shingles int, value string").repartition(5)
        assert sorted(map(tuple, near_groups(df, how).collect())) == by_hand(docs, how.words, how.percent)


def test_a_hub_that_is_not_central_loses_no_link(spark):
    """Neighbours in a chain are alike, its ends are not, and no entry is like all others."""
    words = [f"w{i}" for i in range(140)]
    chain = [" ".join(words[2 * i:2 * i + 60]) for i in range(30)]
    docs = list(enumerate(chain))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted(map(tuple, near_groups(df, Likeness(words=1, percent=90)).collect()))
    assert found == by_hand(docs, 1, 90)


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    found = sorted(map(tuple, near_groups(df).collect()), key=repr)
    assert found == sorted([(2, 2, 2, True), (2, 2, 2, True), (None, 2, 2, False), (None, 0, None, True)], key=repr)
    assert near_groups(df.limit(0)).count() == 0
    kept = drop_near(df.withColumn("kept", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, "a b c d e f"), (None, None)], key=repr)


def test_unlike_texts_of_one_id_stay_apart(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (None, two + " z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _row string")
    assert sorted(((r.doc_id, r.component_id) for r in near_groups(df).collect()), key=repr) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1)], key=repr)
    assert sorted(r.text for r in drop_near(df).collect()) == [one, two]
    only = spark.createDataFrame([(None, one), (None, one + " x"), (5, two)], "doc_id long, text string")
    assert sorted((r.text for r in drop_near(only).collect()))[-1] == two and drop_near(only).count() == 2


def test_many_unlike_copies_lose_no_link(spark):
    """Copies of one text with few and with many edits, of several lengths, around the threshold."""
    random.seed(9)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(150):
        own = list(base[:random.randint(70, 90)])
        for _ in range(random.randint(0, 6)):
            own[random.randrange(len(own))] = random.choice(["x", "y", f"n{i}"])
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for how in (Likeness(words=3), Likeness(words=2, percent=90, overlap=40)):
        assert sorted(map(tuple, near_groups(df, how).collect())) == by_hand(docs, how.words, how.percent)


def test_shingles_of_short_and_long_texts():
    assert len(shingle_set(b"", 4)) == len(shingle_set(b" \t", 4)) == 0
    assert len(shingle_set(b"a b", 4)) == 1 and shingle_set(b"a b", 4)[0] == shingle_set(b"A  b", 4)[0]
    assert len(shingle_set(b"x " * 100_000, 4)) == 1
    assert shingle_set(b"a b c", 5)[0] != shingle_set(b"c b a", 5)[0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (200, 201), (300, 300)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

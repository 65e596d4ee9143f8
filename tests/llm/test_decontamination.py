from __future__ import annotations

import random
import re

import pytest

from tablewright.llm.decontamination import Windows, contamination, item_windows, merged, normal_words, spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    """Every window of every item against every place of every document."""
    out = []
    for doc, text in docs:
        own, hit, found = words_of(text), set(), set()
        for item, other in items:
            theirs = words_of(other)
            size = min(n, len(theirs))
            for at in range(len(theirs) - size + 1) if size else ():
                for place in range(len(own) - size + 1):
                    if own[place:place + size] == theirs[at:at + size]:
                        hit.update(range(place, place + size))
                        found.add("" if item is None else str(item))
        out.append((doc, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus(seed):
    random.seed(seed)
    letters = ["A", "b", "Ça", "7", "straße", "E"]
    text = lambda n: "".join(random.choice(letters) + random.choice([" ", ", ", "\n", "\x00", "'"]) for _ in range(n))
    items = [(i, text(random.randint(0, 9))) for i in range(12)] + [(None, "b b b b b"), (3, None), (3, "7 7 7 7"), (20, "..."), (None, "A E")]
    docs = [(d, text(random.randint(0, 60))) for d in range(40)] + [(None, "B b-b B b b"), (7, None), (7, ""), (8, items[4][1] * 3)]
    return docs, items


@pytest.mark.parametrize("n, per_automaton", [(4, 1_000), (4, 3), (1, 2), (10, 5)])
def test_against_brute_force(spark, n, per_automaton):
    docs, items = corpus(n)
    found = contamination(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS items", "2 AS n_words"),
        spark.createDataFrame(items, "item_id long, text string"), n, per_automaton,
    ).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=repr) == brute(docs, items, n)
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append(text or "")
    for r in found:  # the spans are the hit words of the original
        assert any(sum(len(words_of(t[a:b])) for a, b in zip(r.starts, r.ends)) == r.n_hit for t in texts[r.doc_id])


def test_spans_are_places_in_the_original():
    text = "Ü, One-two\tTHREE four. one two"
    windows = Windows([(b"one two three", ["a"]), (b"one two", ["b"]), (b"four", ["c"])])
    runs, items = windows.find(normal_words(text.encode()))
    assert items == {"a", "b", "c"} and runs == [[1, 6]]
    assert [text[a:b] for a, b in zip(*spans(text, runs))] == ["One-two\tTHREE four. one two"]
    assert merged([[4, 5], [0, 1], [2, 2], [7, 9], [8, 8]]) == [[0, 2], [4, 5], [7, 9]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in contamination(docs, items.limit(0)).collect()] == [(2, 0)]
    assert contamination(docs.limit(0), items).count() == 0
    assert item_windows(items.limit(0)).count() == 0
    assert [(r.item, bytes(r.window)) for r in item_windows(items, 1).orderBy("window").collect()] == [("1", b"a"), ("1", b"b")]


def test_a_long_text_full_of_matches(spark):
    docs = spark.createDataFrame([(1, "x y z " * 100_000), (2, "y")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "x y z x y z x y z x y z") for i in range(50)], "item_id long, text string")
    first, second = sorted(contamination(docs, items).collect(), key=lambda r: r.doc_id)
    assert (first.n_words, first.n_hit, len(first["items"]), first.starts, first.ends) == (300_000, 300_000, 50, [0], [599_999])
    assert (second.n_hit, second["items"]) == (0, [])

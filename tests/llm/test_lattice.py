from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.lattice import Lattice, _weighted, estimate, lattice_scores

SMALL = _weighted({b"": 1.0, b"a": 2.0, b"ab": 1.0, b"b": 0.5}, {b"a": 1.0, b"b": 2.0, b"ba": 1.5, b"bab": 0.25}, 2.0)


def over_all_cuts(word: bytes, voc) -> float:
    total = 0.0
    for cuts in product([0, 1], repeat=max(len(word) - 1, 0)):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:z] for a, z in zip(edges, edges[1:])]
        inside = [voc.inside.get(p, -math.inf) for p in parts]
        total += math.exp(voc.first.get(parts[0], -math.inf) + sum(inside[1:])) + math.exp(voc.first[b""] + sum(inside))
    return total * math.exp(voc.stop)


def test_forward_sums_all_segmentations():
    words = [bytes(w) for n in range(1, 8) for w in product(b"ab", repeat=n)]
    lattice = Lattice(SMALL)
    brute = np.log([over_all_cuts(w, SMALL) for w in words])
    assert np.allclose(lattice.log_q(words), brute)
    assert np.allclose([lattice._one(w) for w in words], brute)
    assert np.exp(brute).sum() < 1


def test_words_sum_to_at_most_one():
    lattice = Lattice(SMALL)
    total = sum(np.exp(lattice.log_q([bytes(w) for w in product(b"ab", repeat=n)])).sum() for n in range(1, 15))
    assert 0.85 < total <= 1  # longer words and the empty one have the rest


def test_expected_uses_raise_the_likelihood(spark):
    random.seed(2)
    words = ["".join(random.choice(["ab", "a", "bab"]) for _ in range(3)).encode() for _ in range(50)]
    table = spark.createDataFrame([(w, 1) for w in set(words)], "word binary, n long")
    better = estimate(table, SMALL, rounds=3)
    own = sorted(set(words))
    assert Lattice(better).log_q(own).sum() > Lattice(SMALL).log_q(own).sum()
    first, inside, stops = Lattice(SMALL).expected([b"ab"])
    assert stops == 1 and first.sum() == pytest.approx(1)


def test_long_words_count_in_the_estimate(spark):
    """A word of more than 64 bytes has the expected uses that the lattice of short ones gives."""
    lattice, short = Lattice(SMALL), [bytes(w) for n in range(1, 8) for w in product(b"ab", repeat=n)]
    uses = [np.zeros(len(SMALL.first)), np.zeros(len(SMALL.inside))]
    for word in short:
        lattice._expected_one(word, uses)
    first, inside, stops = lattice.expected(short)
    assert np.allclose(uses[0], first) and np.allclose(uses[1], inside) and stops == len(short)
    long = b"bab" * 30
    first, inside, stops = lattice.expected([long])
    sizes = np.array([len(p) for p in [*lattice.names[0], b"", *lattice.names[1]]])
    assert stops == 1 and first.sum() == pytest.approx(1) and sizes @ np.concatenate([first, inside]) == pytest.approx(len(long))
    better = estimate(spark.createDataFrame([(long, 1)], "word binary, n long"), SMALL, rounds=1)
    assert Lattice(better).log_q([long])[0] > Lattice(SMALL).log_q([long])[0] + 1


def test_scores_of_documents(spark):
    texts = {0: "ab AB b", 1: None, 2: "", 3: "a" * 300, 4: "ab\x0bb ab", 5: "ba É", 6: "ab b", 7: "never seen", 8: "b b b b"}
    docs = spark.createDataFrame([(i, t, "x" if i % 2 else None, 7) for i, t in texts.items()], "doc_id long, text string, lang string, score int")
    voc = _weighted({b"": 1.0, b"ab": 1.0}, {bytes([b]): 1.0 for b in range(256)} | {b"ab": 5.0}, 30.0)
    learn = F.col("doc_id") != 7
    rows = {r.doc_id: r for r in lattice_scores(docs, voc, learn, rounds=1).collect()}
    counts, ends = Counter(), 0
    for i, t in texts.items():
        if i != 7:
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        r = rows[i]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (i != 7, len(words) + 1, 1 + sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base) and -math.inf < r.score < 0
    assert rows[8].score > rows[7].score


def test_probabilities_of_all_short_texts_stay_below_one(spark):
    words = ["a", "b", "ab"]
    texts = [" ".join(t) for n in range(4) for t in product(words, repeat=n)]
    docs = spark.createDataFrame(
        [(i, t, None) for i, t in enumerate(texts)] + [(1000, "a a b", "x"), (1001, "ab", "y"), (1002, "", "y")], "doc_id long, text string, lang string")
    rows = lattice_scores(docs, SMALL, F.col("doc_id") >= 1000, rounds=0).filter("not learned").collect()
    assert 0.3 < sum(10**r.score for r in rows) < 1


def test_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab", None), (1, "ab", None)], "doc_id long, text string, lang string")
    none = lattice_scores(docs, SMALL, F.lit(False)).collect()
    assert len(none) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in none)
    assert lattice_scores(docs.limit(0), SMALL, F.lit(True)).count() == 0
    assert zlib.crc32(b"1") % 5 in range(5)

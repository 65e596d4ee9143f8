from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm.packing import OpenBins, _Encoder, _sizes, pack, token_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
ENCODER = _Encoder(PATH)


def ids_of(text: str) -> list[int]:
    return MODEL.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r 　\x1c'sté1²½|%"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    found = [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)]
    assert found == [ids_of(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n'\"(),.-_!#$~019asteßÀéñøŉɏ×÷»…"), max_size=60), max_size=5))
def test_words_at_borders_of_letters_digits_and_others(texts):
    found = [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)]
    assert found == [ids_of(t) for t in texts]


def test_plain_words_need_no_second_split():
    texts = ["one, two (three) 4th\nfive-six élan!", "a1b2 x", "two one,"]
    own, wanted = _Encoder(PATH), [ids_of(t) for t in texts]
    own.model = None
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == wanted


def test_a_vocabulary_that_spans_borders_keeps_the_split():
    parts = json.loads(MODEL.to_str())
    assert _sizes(parts) is not None
    for merge in (["a", "1"], ["1", "."], ["Ã©", "!"], ["!", "a"]):
        assert _sizes(parts | {"model": parts["model"] | {"merges": [merge]}}) is None
    assert _sizes(parts | {"normalizer": {"type": "NFC"}}) is None
    assert _sizes(parts | {"model": parts["model"] | {"ignore_merges": True}}) is None


def test_words_beyond_the_cache():
    own = _Encoder(PATH, 3)
    texts = ["one two three four\nfive, six", "two <|endoftext|> ten", "", "six seven\neight"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [ids_of(t) for t in texts]


def test_pieces_hold_every_id(spark):
    texts = {1: None, 2: "", 3: "a b", 4: "word and " * 400, 5: " x\n\n y "}
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, ids string")
    rows = token_pieces(docs, PATH, capacity=64).orderBy("doc_id", "piece").collect()
    for doc, text in texts.items():
        own = [r for r in rows if r.doc_id == doc]
        whole = b"".join(bytes(r.ids) for r in own)
        assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(text or ""), 0]
        assert all(r.length == 64 for r in own[1:]) and 0 < own[0].length <= 64
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
    assert token_pieces(docs.limit(0), PATH).count() == 0
    bare = token_pieces(docs, PATH, capacity=64, with_ids=False).orderBy("doc_id", "piece").collect()
    assert [tuple(r) for r in bare] == [tuple(r)[:-1] for r in rows]


def test_best_fit_and_the_fullest_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.put(3) == (1, 7)  # exactly full, closes
    assert bins.put(5) == (2, 0)
    assert bins.put(8) == (3, 0)  # bin 0, the fullest, closed
    assert bins.put(4) == (2, 5)


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_bins_agree_with_a_plain_search(limit):
    random.seed(limit)
    bins, free = OpenBins(50, limit), {}
    for _ in range(600):
        n = random.randint(1, 50)
        number, offset = bins.put(n)
        fitting = [f for f in free.values() if f >= n]
        if fitting:
            assert 50 - offset == min(fitting) == free[number]
        else:
            if len(free) >= limit:
                closing = min(free.values())
                del free[next(k for k in free if free[k] == closing and k not in {b for f, own in bins.by_free.items() for b in own})]
            assert offset == 0
        free[number] = 50 - offset - n
        if not free[number]:
            del free[number]


def test_sequences_are_gapless_and_repeat_themselves(spark):
    random.seed(1)
    lengths = [random.randint(1, 64) for _ in range(500)]
    rows = [(i, 0, n, "kept") for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame([*rows, rows[7]], "doc_id long, piece int, length long, extra string")
    first = pack(pieces, capacity=64, open_bins=32, per_task=100)
    placed = [tuple(r) for r in first.select("sequence_id", "offset", "length").collect()]
    assert len(placed) == 501 and "extra" in first.columns
    by_sequence = {}
    for sequence, offset, length in placed:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) < 1.2 * sum(n for *_, n in placed) / 64
    again = [tuple(r) for r in pack(pieces, capacity=64, open_bins=32, per_task=100).select("sequence_id", "offset", "length").collect()]
    assert sorted(again) == sorted(placed)
    assert pack(pieces.limit(0)).count() == 0


def test_pieces_may_carry_anything(spark):
    pieces = spark.createDataFrame([(i, 3 + i % 7) for i in range(40)], "row long, length int").selectExpr(
        "*", "'old' AS offset", "map('a', row) AS m", "current_date() AS d", "cast(null AS decimal(9,2)) AS _order", "9 AS sequence_id", "7 AS number")
    out = pack(pieces, capacity=9)
    assert out.count() == 40 and out.columns == ["row", "length", "m", "d", "_order", "number", "sequence_id", "offset"]
    assert {r.row: r.m["a"] for r in out.collect()} == {i: i for i in range(40)}

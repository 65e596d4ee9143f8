from __future__ import annotations

import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.pieces import UNKNOWN, Pieces, decoded, encoded, rank_scores

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = Pieces(PATH)
SCORES = sentencepiece.SentencePieceProcessor(model_file=PATH)


def best_by_hand(text: str) -> float:
    """The best score over all cuts of a short text."""
    known = {SCORES.id_to_piece(i): SCORES.get_score(i) for i in range(259, SCORES.get_piece_size())}
    best = float("-inf")
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        total = 0.0
        for a, z in zip(edges, edges[1:]):
            part = text[a:z]
            if part in known:
                total += known[part]
            elif z - a == 1:
                total += min(known.values()) - UNKNOWN
            else:
                break
        else:
            best = max(best, total)
    return best


@pytest.mark.parametrize("text", ["▁the", "▁tiontion", "▁étéŒ", "▁a▁b", "▁▁▁x", "日本▁\u0378q"])
def test_search_finds_the_best_score(text):
    ids, score, uncovered = MODEL.search(text)
    assert score == best_by_hand(text)
    assert MODEL.decode(np.array(ids, "i").tobytes()).decode() == text.replace("▁", " ").removeprefix(" ")
    assert (uncovered > 0) == ("\u0378" in text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\0abcté▂日"), st.characters(exclude_categories=["Cs"], exclude_characters="▁")), max_size=60))
def test_word_by_word_is_the_whole_and_decodes_to_it(text):
    ids, score, _ = MODEL.encode(text)
    assert MODEL.decode(ids).decode() == text
    if text:
        whole, best, _ = MODEL.search("▁" + text.replace(" ", "▁"))
        assert score == best and np.frombuffer(ids, "i").tolist() == whole


def message(*fields) -> bytes:
    """Bytes of a protocol-buffer message of (number, value); numbers below 2**28."""

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A file of the same pieces as a unigram model with the scores of their ranks; nothing is trained."""
    usual = [i for i in range(SCORES.get_piece_size()) if not (SCORES.is_byte(i) or SCORES.is_control(i) or SCORES.is_unknown(i))]
    scores = dict(zip(usual, rank_scores([SCORES.get_score(i) for i in usual])))
    fields = []
    for i in range(SCORES.get_piece_size()):
        kind = 2 if SCORES.is_unknown(i) else 3 if SCORES.is_control(i) else 6 if SCORES.is_byte(i) else 1
        fields.append((1, message((1, SCORES.id_to_piece(i).encode()), (2, float(scores.get(i, 0.0))), (3, kind))))
    fields.append((2, message((3, 1), (4, len(fields)), (35, 1))))
    fields.append((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(message(*fields))
    return str(path)


def test_ids_are_those_of_the_library_for_a_unigram_model(unigram):
    library, own, ranked = sentencepiece.SentencePieceProcessor(model_file=unigram), Pieces(unigram), Pieces(PATH, ranks=True)
    random.seed(4)
    words = ["hello", "world", "unsegmentable", "étés", "日本語", "0x7f", "q\u0378", "tiontion", "END", "a\tb", "-", "Zürich", "xyzzy"]
    texts = ["hello world", " a  b ", *(" ".join(random.choices(words, k=random.randint(1, 12))) for _ in range(300))]
    texts += ["".join(random.choices("etaoin shrdlu.,", k=80)) for _ in range(300)]
    for text in texts:
        ids = library.encode(text)
        assert np.frombuffer(own.encode(text)[0], "i").tolist() == ids
        assert np.frombuffer(ranked.encode(text)[0], "i").tolist() == ids


def test_rows(spark):
    random.seed(1)
    texts = [None, "", "a  b\n", "x" * 3000, "ab " * 500, "▁"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(2, texts[2], 0.5)], "doc_id long, text string, score double")
    codes = encoded(docs, PATH, ranks=True)
    back = {r.doc_id: r.text for r in decoded(codes, PATH, ["score"]).collect()}
    assert back == {i: (" " if t == "▁" else t or "") for i, t in enumerate(texts)}
    assert encoded(docs.limit(0), PATH).count() == 0 and codes.count() == 7

from __future__ import annotations

import datetime
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import repeats
from tablewright.llm.repeats import FIFTY_WORDS, Passages, cells, cut_repeats, phrases, without_repeats


def covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    occurs = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        own = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if occurs[t[i:i + length]] > 1:
                own[i:i + length] = True
        out.append(own)
    return out


def corpus(seed: int) -> list[str | None]:
    random.seed(seed)

    def prose(n):
        return " ".join("".join(random.choice(["th", "er", "in", "on", "é", "ß", "a"]) for _ in range(random.randint(1, 4))) for _ in range(n))

    bases, passages, docs = [prose(300) for _ in range(4)], [prose(120) for _ in range(3)], [None, "", "ab " * 300, "x" * 400, "x" * 399]
    for _ in range(30):
        kind = random.random()
        if kind < 0.25:
            docs.append(random.choice(bases))
        elif kind < 0.45:
            words = random.choice(bases).split(" ")
            for _ in range(random.randint(1, 4)):
                words[random.randrange(len(words))] = "new"
            docs.append(" ".join(words))
        elif kind < 0.75:
            docs.append(prose(random.randint(0, 150)) + " " + random.choice(passages) + " " + prose(random.randint(0, 80)))
        elif kind < 0.9:
            docs.append(random.choice(passages)[:random.randint(395, 420)] + prose(20))
        else:
            docs.append(prose(random.randint(0, 300)))
    return docs


def window_texts():
    random.seed(3)
    noise = bytes(random.choice(b"abcd ") for _ in range(5000))
    return [noise, b"a" * 3000, b"ab" * 300 + bytes(random.choice(b"xyz") for _ in range(900)), b"x" * 400, b"y" + noise[100:2000] + b"z"]


def test_a_trigger_is_the_least_hash_and_depends_on_the_window_alone():
    how = Passages()
    where: dict[bytes, int] = {}
    for text in window_texts():
        for start, trigger in enumerate(repeats.triggers(text, how).tolist()):
            assert 0 <= trigger - start < how.reach
            assert where.setdefault(text[start:start + 400], trigger - start) == trigger - start


@pytest.mark.parametrize("width", Passages().steps)
def test_every_window_lies_in_one_cell_around_its_core(width):
    how = Passages()
    for text in window_texts():
        runs = phrases(text, how)
        starts = []
        for _, first, windows, head, end in zip(*cells(*runs, width, how)):
            starts += range(first, first + windows)
            assert first + windows - 1 <= head and end <= first + how.length and end - head == how.length - width + 1
        assert sorted(starts) == list(range(len(text) - 399))


def test_hashes_that_reach_out_of_a_window_are_refused():
    for wrong in ({"length": 100}, {"steps": (128, 16)}, {"rolling": 12}, {"block": 1 << 20}):
        with pytest.raises(ValueError):
            Passages(**wrong)


@pytest.mark.parametrize("how", [Passages(block=700), Passages(core_bits=1), Passages(length=64, rolling=4, steps=(32, 1))])
def test_other_blocks_colliding_cores_and_other_lengths(spark, how):
    texts = [t for t in corpus(7) if t] + ["ab " * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in without_repeats(docs, how).collect()}
    assert found == {i: own.sum() for i, own in enumerate(covered([t.encode() for t in texts], how.length))}


@pytest.mark.parametrize("seed", [1, 2])
def test_exactly_the_bytes_of_repeated_windows_go(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    found = {r.doc_id: r for r in without_repeats(docs).collect()}
    whole = [(t or "").encode() for t in texts]
    for i, own in enumerate(covered(whole, 400)):
        runs = int((np.diff(np.concatenate([[0], own.astype(int)])) == 1).sum())
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(whole[i]), own.sum(), runs)
        assert bytes(r.kept) == np.frombuffer(whole[i], np.uint8)[~own].tobytes()


def test_stage_keeps_rows_and_columns(spark):
    """Columns of any type pass; a text without id takes part like the others."""
    texts = corpus(5)
    texts.append(texts[5])
    day, price = datetime.date(2024, 2, 29), Decimal("1.50")
    rows = [(i, t, "en", len(t or ""), day, price, {"a": 1}, [(1, None)]) for i, t in enumerate(texts)]
    rows[-1] = (None, *rows[-1][1:])
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_chars int, _spans date, _row decimal(5,2), `row` map<string,int>, parts array<struct<a:smallint,b:timestamp>>")
    out = cut_repeats(docs)
    assert out.schema == docs.schema
    out = out.collect()
    assert len(out) == len(texts)
    for row, own in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), covered([(t or "").encode() for t in texts], 400)):
        before = texts[-1 if row.doc_id is None else row.doc_id]
        assert (row.text == before) if not own.any() else row.n_chars == len(row.text) < len(before)
        assert (row.lang, row["_spans"], row["_row"], row["row"], row.parts[0].a) == ("en", day, price, {"a": 1}, 1)
    assert cut_repeats(docs.filter(F.lit(False))).count() == 0


def test_texts_of_one_id_lose_only_their_own_repeats(spark):
    passage = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(1, passage), (1, "0123456789"), (2, passage), (None, "a")], "doc_id long, text string")
    assert sorted(r.text for r in cut_repeats(docs).collect()) == ["", "", "0123456789", "a"]
    assert sorted(((r.doc_id, r.n_removed) for r in without_repeats(docs).collect()), key=repr) == sorted([(1, len(passage)), (1, 0), (2, len(passage)), (None, 0)], key=repr)


def test_repeated_rows_are_occurrences(spark):
    text = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in without_repeats(docs).collect()) == [(1, len(text)), (1, len(text)), (2, 0)]


def words_covered(texts: list[bytes], length: int) -> list[list[bool]]:
    words = [t.lower().split() for t in texts]
    occurs = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = [[False] * len(w) for w in words]
    for w, own in zip(words, out):
        for i in range(len(w) - length + 1):
            if occurs[tuple(w[i:i + length])] > 1:
                own[i:i + length] = [True] * length
    return out


def words_kept(text: bytes, own: list[bool]) -> bytes:
    kept, places = bytearray(text), [*re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    for i in reversed(range(len(places))):
        if own[i]:
            del kept[places[i].start():places[i + 1].start() if i + 1 < len(own) and own[i + 1] else places[i].end()]
    return bytes(kept)


@pytest.mark.parametrize("how", [FIFTY_WORDS, Passages(length=50, rolling=4, steps=(32, 4, 1), words=True, block=60, core_bits=1), Passages(length=9, rolling=2, steps=(8, 1), words=True)])
def test_exactly_the_words_of_repeated_windows_go(spark, how):
    random.seed(4)
    texts = [t or "" for t in corpus(9)] + [" ", "a " * 200, " lead " + "x y\u00a0z " * 40, "one\t\r\n two", "w" * 3000 + " " + "ab c " * 300]
    texts += [re.sub(" ", lambda _: random.choice([" ", "\n", " \t ", "\x0b"]), t.upper() if i % 2 else t) + "  " for i, t in enumerate(texts[4:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: bytes(r.kept) for r in without_repeats(docs, how).collect()}
    whole = [t.encode() for t in texts]
    assert found == {i: words_kept(t, own) for i, (t, own) in enumerate(zip(whole, words_covered(whole, how.length)))}


def test_pipeline_cuts_passages_of_over_fifty_words_below_400_bytes(spark):
    """Passages of 400 bytes in fewer words still go; 49 words and clean documents stay."""
    passage, less = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(49))
    long_words = " ".join("r" * 60 + str(i) for i in range(8))
    assert len(passage) < 400 < len(long_words)
    texts = {1: f"one {passage} two", 2: "three\n" + passage.replace(" ", "\n").upper() + "\nfour", 3: f"five {less} six", 4: f"seven {less} eight",
             5: f"nine {long_words} ten", 6: f"eleven {long_words} dozen", 7: "clean text", 8: None}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars int")
    found = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert {i: r.text for i, r in found.items()} == texts | {1: "one  two", 2: "three\n\nfour", 5: "nineten", 6: "elevendozen"}
    assert found[1].n_chars == len("one  two")

"""Benchmark passages in documents: one Aho-Corasick automaton over windows of benchmark words.

Texts are normalised to words: A-Z in lower case, runs of digits, letters and characters
beyond ASCII. The automaton's symbols are the numbers of benchmark words, so a document is
read once, word by word, and a match ends at a word whose place in the original text is known.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped, whole_texts
from tablewright.session import written

WINDOWS_PER_AUTOMATON = 300_000  # at most so many windows, and
BYTES_PER_AUTOMATON = 48 << 20  # so many bytes of them, are held by a worker at once
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def normal_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text."""
    return text.translate(_NORMAL).split()


def item_windows(items: DataFrame, words: int = 10) -> DataFrame:
    """item (its id as text) and window, each pair once: all runs of ``words`` words.

    An item of fewer words is one window of all of them; one without words, or null, has none.
    A null item_id is the item with the empty id; rows that share an id are one item.
    """

    def run(batches):
        for b in batches:
            for item, text in zip(b["item"], b["text"]):
                own = normal_words(text)
                for at in range(max(1, len(own) - words + 1) if own else 0):
                    yield item, b" ".join(own[at:at + words])

    texts = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.expr("coalesce(cast(text as binary), X'')").alias("text"),
    )
    return mapped(texts, run, "item string, window binary").distinct()


class _Numbers(dict):
    """Numbers of words; 0 for words that no window has."""

    def __missing__(self, word):
        return 0


class Windows:
    """The automaton of some windows, and the items that each of them belongs to."""

    def __init__(self, pairs: Iterable[tuple[bytes, list[str]]]):
        import ahocorasick

        self.numbers, self.items = _Numbers(), []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in pairs:
            words = window.split()
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            self.automaton.add_word(key, (len(key), len(self.items)))
            self.items.append(items)
        if self.items:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal runs of words inside matches, as [first, last], and the items that match."""
        if not self.items:
            return [], set()
        runs: list[list[int]] = []
        seen: set[int] = set()
        for last, (length, window) in self.automaton.iter(tuple(map(self.numbers.__getitem__, words))):
            first = last - length + 1
            while runs and runs[-1][0] >= first:
                runs.pop()
            if runs and runs[-1][1] >= first - 1:
                runs[-1][1] = last
            else:
                runs.append([first, last])
            seen.add(window)
        return runs, {item for window in seen for item in self.items[window]}


_held: dict[str, Windows] = {}


def _windows(key: str, pairs: Broadcast) -> Windows:
    """A worker's automaton; it lets go of the one it held before."""
    if key not in _held:
        _held.clear()
        _held[key] = Windows(pairs.value)
    return _held[key]


def merged(runs: Iterable[list[int]]) -> list[list[int]]:
    """Runs [first, last] in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def spans(text: str, runs: list[list[int]]) -> tuple[list[int], list[int]]:
    """Starts and ends, in code points of the original text, of runs of its words."""
    starts, ends, at = [], [], 0
    for number, word in enumerate(_WORD.finditer(text)) if runs else ():
        if number == runs[at][0]:
            starts.append(word.start())
        if number == runs[at][1]:
            ends.append(word.end())
            at += 1
            if at == len(runs):
                break
    return starts, ends


def contamination(docs: DataFrame, items: DataFrame, words: int = 10, per_automaton: int = WINDOWS_PER_AUTOMATON) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, starts, ends.

    A word is hit when it lies in an occurrence of an item's window (see ``item_windows``).
    ``items`` are the ids with an occurring window, as text and sorted; ``starts`` and ``ends``
    are the maximal runs of hit words as code point offsets of the original text. Null and empty
    texts have no words. Repeated rows repeat, other columns of ``docs`` go, and an empty table
    gives no rows; without items nothing is hit.

    The windows are counted first. As many as an automaton may hold are broadcast; more are
    dealt out to several automata, each of which reads the texts once, and the runs of one text
    are merged afterwards.
    """
    spark = docs.sparkSession
    pairs = written(item_windows(items, words), "benchmark-windows")
    count, size = pairs.agg(F.count_distinct("window"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    parts = max(1, -(-count // per_automaton), -(-size // BYTES_PER_AUTOMATON))
    texts = whole_texts(docs)
    if parts > 1:
        texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "decontamination-texts")
    else:
        texts = texts.withColumn("row", F.lit(0).cast("long"))

    def scanned(part: int) -> DataFrame:
        own = pairs.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        held: dict[bytes, list[str]] = {}
        for r in own.toLocalIterator():  # no more than one automaton may hold
            held.setdefault(bytes(r.window), []).append(r.item)
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(list(held.items()))

        def run(batches):
            windows = _windows(key, shared)
            for b in batches:
                for row, doc, text in zip(b["row"], b["doc_id"], b["text"]):
                    found = normal_words(text)
                    runs, names = windows.find(found)
                    starts, ends = spans(text.decode("utf-8", "replace"), runs) if runs else ([], [])
                    firsts, lasts = ([r[i] for r in runs] for i in (0, 1))
                    yield row, doc, len(found), firsts, lasts, sorted(names), starts, ends

        return mapped(texts, run, "row long, doc_id long, n_words long, firsts array<long>, lasts array<long>, items array<string>, starts array<long>, ends array<long>")

    if parts == 1:
        whole = scanned(0)
    else:
        whole = written(_united([scanned(part) for part in range(parts)]), "decontamination")
    run_lengths = F.zip_with("firsts", "lasts", lambda a, b: b - a + 1)
    return whole.select(
        "doc_id", "n_words", F.aggregate(run_lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"), "items", "starts", "ends"
    )


def _united(parts: list[DataFrame]) -> DataFrame:
    """One row per text from those of each automaton; a text has as many rows as there are automata."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts", "items", "starts", "ends")]
    texts = every.groupBy("row", "doc_id", "n_words").agg(*lists)

    def run(batches):
        for b in batches:
            for row, doc, n, firsts, lasts, items, starts, ends in zip(*b.values()):
                runs = merged(zip(firsts, lasts))
                # A run's place in the text is that of its first and last word in any automaton.
                start_of, end_of = dict(zip(firsts, starts)), dict(zip(lasts, ends))
                yield (row, doc, n, [r[0] for r in runs], [r[1] for r in runs], sorted(set(items)),
                       [start_of[r[0]] for r in runs], [end_of[r[1]] for r in runs])

    return mapped(texts, run, "row long, doc_id long, n_words long, firsts array<long>, lasts array<long>, items array<string>, starts array<long>, ends array<long>")

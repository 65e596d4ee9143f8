"""Repeated passages by prefix-free parsing.

A rolling hash over a few bytes sets triggers: each window (a string of ``length`` bytes) has
as its trigger the place of the least hash among its first ``reach`` ones, the last such place
on a tie. So equal windows have their triggers at the same distance, every window has one, and
a phrase is a run of windows that share their trigger. The corpus is a dictionary of phrases
and a parse that says where they occur.

All windows of a phrase that the parse holds twice are repeated. Other windows can only be
repeated where phrases have the same core, the bytes that all windows have in common whose
triggers lie in one range of distances. Of such phrases the dictionary is cut into finer ranges
of distances, once each with the number of their occurrences, and so on down to single windows.
What is left shrinks from step to step, as longer cores are shared by fewer phrases.

Strings are in the order of their digests rather than alphabetical: which are equal, and so the
result, does not depend on the order of the alphabet. Cores only say where to look; strings
count as equal when their 128-bit BLAKE2 digests are.

Windows are of bytes or of words. Words lie between white space and are equal when they are
after lower-casing A-Z; a text is then its words with a space behind each, and all places
count words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablewright.llm.common import WHITE_SPACE, mapped, mapped_arrays, numbered, numbered_texts, unused
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import drop_unread, written

BROADCAST_CORES = 6_000_000
_PLACE = 20  # bits of a place in a block and the bytes behind it
_ODD = np.random.default_rng(20_000).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_AT_ONCE = 256  # rows that are Python objects at a time
_SPACE = 32
_FOLDED = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(WHITE_SPACE, b" " * len(WHITE_SPACE))), np.uint8)


@dataclass(frozen=True)
class Passages:
    """Bytes, or ``words``, of a window and of the rolling hash; ``steps`` are the widths of the
    ranges of distances, from all places that a window's trigger can have (``reach``) to one. The
    rolling hash and the reach are powers of two. ``block`` windows of a text are looked at together,
    so work does not grow with the longest text; fewer ``core_bits`` only mean more to look at."""

    length: int = 400
    rolling: int = 16
    steps: tuple[int, ...] = (128, 16, 1)
    block: int = 1 << 18
    core_bits: int = 64
    words: bool = False

    def __post_init__(self):
        if self.reach + self.rolling - 1 > self.length or self.steps[-1] != 1:
            raise ValueError("the hashes of a window must lie inside it, and the last step is 1")
        if any(n & (n - 1) for n in (self.reach, self.rolling)):
            raise ValueError("the rolling hash and the reach must be powers of two")
        if not 0 < self.block <= (1 << _PLACE) - 2 * self.length or not 0 < self.core_bits <= 64:
            raise ValueError("a place in a block has 20 bits, a core's hash at most 64")

    @property
    def reach(self) -> int:
        return self.steps[0]


FIFTY_WORDS = Passages(length=50, rolling=4, steps=(32, 4, 1), block=1 << 15, words=True)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text`` begin and end."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = _FOLDED[np.frombuffer(text, np.uint8)] == _SPACE
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(gap[1:] & ~gap[:-1])


def word_blocks(text: bytes, how: Passages) -> Iterator[tuple[int, bytes]]:
    """Number and words, a space behind each, of the blocks of a text that holds a window."""
    folded = np.append(_FOLDED[np.frombuffer(text, np.uint8)], np.uint8(_SPACE))
    gap = folded == _SPACE
    gap[1:] &= gap[:-1]  # white space behind white space
    gap[0] = folded[0] == _SPACE
    folded = folded[~gap]
    ends = _ends(folded)
    for base in range(0, len(ends) - how.length + 1, how.block):
        last = min(base + how.block + how.length - 1, len(ends)) - 1
        yield base // how.block, folded[ends[base - 1] + 1 if base else 0:ends[last] + 1].tobytes()


def _ends(data: bytes | np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(data, np.uint8) == _SPACE)


def _word_hashes(data: bytes) -> np.ndarray:
    raw, ends = np.frombuffer(data, np.uint8), _ends(data)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)
    return np.add.reduceat(_ODD[raw] * _ODD[place & 255], starts)


def triggers(data: bytes, how: Passages) -> np.ndarray:
    """The place of the trigger of every window of ``data``, by where the window begins."""
    hashes = _word_hashes(data) if how.words else _ODD[np.frombuffer(data, np.uint8)]
    hashes = hashes[:len(hashes) - how.length + how.reach + how.rolling - 1]
    size, factor = 1, _BASE
    while size < how.rolling:  # hashes of twice as many bytes
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    most = np.uint64((1 << _PLACE) - 1)
    least = (hashes & ~most) | (most - np.arange(len(hashes), dtype=np.uint64))
    size = 1
    while size < how.reach:  # least of twice as many places
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return (most - (least & most)).astype(np.int64)


def phrases(data: bytes, how: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and trigger of the phrases of ``data``."""
    at = triggers(data, how)
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return start, np.diff(np.append(start, len(at))), at[start]


def cells(start: np.ndarray, count: np.ndarray, trigger: np.ndarray, width: int, how: Passages):
    """Runs of windows cut where the trigger's distance reaches a multiple of ``width``.

    Arrays of which run a cell is from, its first window and number of windows, and the first
    and last place of its core.
    """
    low = (trigger - start - count + 1) // width
    number = (trigger - start) // width - low + 1
    of = np.repeat(np.arange(len(start)), number)
    head = trigger[of] - width * (low[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number))
    first = np.maximum(start[of], head - width + 1)
    last = np.minimum(start[of] + count[of] - 1, head)
    return of, first, last - first + 1, head, head - width + 1 + how.length


def _strings(data: bytes, first: np.ndarray, stop: np.ndarray, how: Passages) -> Iterator[memoryview]:
    """The bytes of ``data`` from the places ``first`` to before the places ``stop``."""
    if how.words:
        edges = np.append(-1, _ends(data))
        first, stop = edges[first] + 1, edges[stop]
    view = memoryview(data)
    return (view[a:z] for a, z in zip(first.tolist(), stop.tolist()))


def _cores(data: bytes, head: np.ndarray, end: np.ndarray, how: Passages) -> np.ndarray:
    found = [xxhash.xxh3_64_intdigest(x) for x in _strings(data, head, end, how)]
    return (np.array(found, np.uint64) >> np.uint64(64 - how.core_bits)).view(np.int64)


def _block(how: Passages) -> Column:
    return F.floor(F.col("start") / how.block).cast("int")


def blocks(texts: DataFrame, how: Passages) -> DataFrame:
    """row, block and data of all texts that hold a window: ``block`` windows each, or what is left."""
    if how.words:

        def run(batches):
            for b in batches:
                yield from _blocks_of(b, how)

        # Written, as a task that cuts words and looks at them would hold two Python workers, which live on.
        return written(mapped(texts.select("row", "text"), run, "row long, block int, data binary", _AT_ONCE), "word-blocks")
    last = F.octet_length("text") - how.length
    cut = texts.filter(last >= 0).select("row", "text", F.posexplode(F.sequence(F.lit(0), last, F.lit(how.block))).alias("block", "base"))
    return cut.select("row", "block", F.expr(f"substring(text, base + 1, {how.block + how.length - 1})").alias("data"))


def _whole(texts: DataFrame, how: Passages) -> DataFrame:
    """What ``_blocks_of`` makes the blocks of ``texts`` from: words are cut in the task that hashes them."""
    return texts.select("row", "text") if how.words else blocks(texts, how)


def _blocks_of(batch: dict, how: Passages) -> Iterator[tuple[int, int, bytes]]:
    if not how.words:
        return zip(batch["row"], batch["block"], batch["data"])
    return ((row, *block) for row, text in zip(batch["row"], batch["text"]) for block in word_blocks(text, how))


def cores(texts: DataFrame, how: Passages) -> DataFrame:
    """core of every phrase of the parse."""

    def run(batches):
        for b in batches:
            for _, _, data in _blocks_of(b, how):
                *_, head, end = cells(*phrases(data, how), how.reach, how)
                yield [_cores(data, head, end, how)]

    return mapped_arrays(_whole(texts, how), run, "core long")


_PARTS = "row long, start int, windows int, ahead int, often long, core long, name binary"


def _parts(row: int, block: int, data: bytes, runs: tuple[np.ndarray, ...], often: np.ndarray, width: int, how: Passages) -> list:
    base = block * how.block
    start, count, trigger = runs
    of, first, windows, head, end = cells(start, count, trigger, width, how)
    names = [hashlib.blake2b(x, digest_size=16).digest() for x in _strings(data, first, first + windows + how.length - 1, how)]
    return [np.full(len(of), row, np.int64), first + base, windows, trigger[of] - first, often[of], _cores(data, head, end, how), names]


def parse(texts: DataFrame, how: Passages) -> DataFrame:
    """The phrases of all texts that hold a window, of ``windows`` windows from ``start`` on.

    ``ahead`` is how far after ``start`` the trigger lies, ``often`` 1, ``core`` a hash of the
    core and ``name`` a digest of the phrase from its first window's begin to its last one's end.
    """

    def run(batches):
        for b in batches:
            for row, block, data in _blocks_of(b, how):
                runs = phrases(data, how)
                yield _parts(row, block, data, runs, np.ones(len(runs[0]), np.int64), how.reach, how)

    return mapped_arrays(_whole(texts, how), run, _PARTS)


def finer(texts: DataFrame, dictionary: DataFrame, width: int, how: Passages) -> DataFrame:
    """The strings of ``dictionary`` cut into ranges of ``width`` distances, as ``parse`` gives phrases."""
    whole = F.collect_list(F.struct("start", "windows", "ahead", "often")).alias("runs")
    runs = dictionary.withColumn("block", _block(how)).groupBy("row", "block").agg(whole)
    names = ("start", "windows", "ahead", "often")
    runs = written(runs.select("row", "block", *(F.col(f"runs.{c}").alias(c) for c in names)), "open-phrases")

    def run(batches):
        for b in batches:
            for row, block, data, *own in zip(*(b[c] for c in ("row", "block", "data", *names))):
                start, count, ahead, often = (np.array(x, np.int64) for x in own)
                start -= block * how.block
                yield _parts(row, block, data, (start, count, start + ahead), often, width, how)

    few = texts.join(broadcast_if_small(runs.select("row").distinct()), "row", "left_semi")
    return mapped_arrays(blocks(few, how).join(broadcast_if_small(runs), ["row", "block"]), run, _PARTS)


def repeated_spans(texts: DataFrame, how: Passages = Passages()) -> DataFrame:
    """row and spans, flat [start, stop, ...], of the bytes, or words, that repeated windows cover.

    ``texts`` holds row, a number of its own for each, and text as bytes. A window is repeated
    when the same ``length`` bytes, or words, begin anywhere else, in the same text too. Spans are
    sorted and do not touch. Only rows with a span are listed. An empty table gives no rows.
    """
    twice = cores(texts, how).groupBy("core").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select("core")
    twice = written(twice, "repeated-cores")
    # 64-bit numbers: their count is their size. Beyond the bound the phrases are shuffled to them.
    near_by = F.broadcast(twice) if twice.count() <= BROADCAST_CORES else twice
    parts = written(parse(texts, how).join(near_by, "core", "left_semi"), "phrases")
    found = []
    for width in how.steps[1:] + (0,):
        # Of equal strings, windows and ahead are equal too: the first occurrence stands for all.
        dictionary = parts.groupBy("core", "name", "windows", "ahead").agg(F.sum("often").alias("often"), F.min(F.struct("row", "start")).alias("at"))
        dictionary = written(dictionary.select("core", "name", "windows", "ahead", "often", "at.row", "at.start"), "dictionary")
        again = broadcast_if_small(dictionary.filter("often > 1").select("name"))
        # A string that occurs more often than once is a part of one that was found before.
        found.append(parts.filter("often = 1").join(again, "name", "left_semi").select("row", "start", (F.col("start") + F.col("windows") + how.length - 1).alias("stop")))
        if width:
            several = dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("strings"), F.min("often").alias("least"))
            several = written(several.filter("strings > 1 and least = 1").select("core"), "open-cores")
            parts = written(finer(texts, dictionary.join(broadcast_if_small(several), "core", "left_semi"), width, how), "finer-phrases")

    def merge(batches):
        for b in batches:
            for row, edges in zip(b["row"], b["edges"]):
                yield row, _merged((e["start"], e["stop"]) for e in edges)

    # First within blocks, so that no list is longer than a block; then the few spans of a text.
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    edges = F.collect_list(F.struct("start", "stop")).alias("edges")
    by_block = mapped(every.groupBy("row", _block(how).alias("block")).agg(edges).select("row", "edges"), merge, "row long, spans array<int>", _AT_ONCE)
    pairs = F.expr("transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] AS start, spans[i + 1] AS stop))")
    whole = by_block.groupBy("row").agg(F.flatten(F.collect_list(pairs)).alias("edges"))
    return mapped(whole, merge, "row long, spans array<bigint>", _AT_ONCE)


def _merged(edges: Iterable[tuple[int, int]]) -> list[int]:
    spans: list[int] = []
    for start, stop in sorted(edges):
        if spans and start <= spans[-1]:
            spans[-1] = max(spans[-1], stop)
        else:
            spans += [start, stop]
    return spans


def _in_bytes(text: bytes, spans: list[int], how: Passages) -> list[int]:
    """The spans of ``how`` as places of bytes, from the first word's begin to the last one's end."""
    if not how.words or not spans:
        return spans
    starts, ends = word_places(text)
    edges = np.array(spans, np.int64)
    edges[::2], edges[1::2] = starts[edges[::2]], ends[edges[1::2] - 1]
    return edges.tolist()


def without_repeats(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept, the bytes outside the spans.

    Null texts count as empty. Every row is a text of its own, also without a doc_id or with
    that of another. An empty table gives no rows.
    """
    texts = numbered_texts(docs)
    spans = broadcast_if_small(written(repeated_spans(texts, how), "spans"))

    def cut(batches):
        for b in batches:
            for doc, text, own in zip(b["doc_id"], b["text"], b["spans"]):
                own = _in_bytes(text, own or [], how)
                edges = [0, *own, len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                yield doc, len(text), len(text) - len(kept), len(own) // 2, kept

    texts = texts.join(spans, "row", "left").select("doc_id", "text", "spans")
    return mapped(texts, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", _AT_ONCE)


def cut_repeats(docs: DataFrame, *hows: Passages) -> DataFrame:
    """The documents with their columns, ``text`` without repeated passages and ``n_chars`` counted anew.

    What passages of any of ``hows`` cover goes, all judged on the texts as they come; without
    ``hows`` those of 400 bytes. Bytes of a character that a span cuts in two go with the span;
    every row stays, also without any text left. A null text without spans stays null. Other
    columns, of any type that Arrow holds, pass as they are.
    """
    hows = hows or (Passages(),)
    schema = docs.schema
    docs, row, texts = numbered(docs)
    at = schema.names.index("text")
    counted = [i for i, f in enumerate(schema) if f.name == "n_chars" and isinstance(f.dataType, IntegralType)]
    joined, added = docs, []
    for how in hows:
        added.append(unused(joined, "_spans"))
        spans = written(repeated_spans(texts, how), "spans").withColumnsRenamed({"row": row, "spans": added[-1]})
        drop_unread(docs.sparkSession)
        joined = joined.join(broadcast_if_small(spans), row, "left")

    def without(data: bytes, found: tuple[list[int] | None, ...]) -> str:
        own = [_in_bytes(data, spans or [], how) for spans, how in zip(found, hows)]
        edges = [0, *_merged(pair for spans in own for pair in zip(spans[::2], spans[1::2])), len(data)]
        return "".join(data[a:z].decode("utf-8", "ignore") for a, z in zip(edges[::2], edges[1::2]))

    def cut(batches):
        for b in (b.slice(i, _AT_ONCE) for b in batches for i in range(0, b.num_rows, _AT_ONCE)):
            columns, spans = b.columns[:-len(hows)], [*zip(*(c.to_pylist() for c in b.columns[-len(hows):]))]
            if any(map(any, spans)):
                before = columns[at].cast(pa.large_binary() if pa.types.is_large_string(columns[at].type) else pa.binary())
                new = [without(before[i].as_py(), s) if any(s) else None for i, s in enumerate(spans)]
                is_new = pa.array([n is not None for n in new])
                columns[at] = pc.if_else(is_new, pa.array(new, columns[at].type), columns[at])
                for i in counted:
                    columns[i] = pc.if_else(is_new, pa.array([None if n is None else len(n) for n in new], columns[i].type), columns[i])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select(*schema.names, *added).mapInArrow(cut, schema)

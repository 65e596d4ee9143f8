"""Tokens of documents in pieces, and bounded-space online best-fit packing of the pieces."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped, whole_texts
from tablewright.session import written

CACHED = 200_000  # words whose ids a Python worker remembers, about 200 bytes each
TEXTS = 128  # texts whose words are looked up together
PER_TASK = 32_768  # pieces that one task packs
FULL = 1 << 62  # from here on, numbers of sequences that one piece fills


class _Encoder:
    """Ids of texts as little-endian 32-bit bytes, word by word where words are independent.

    The tokenizer splits texts at every space or line break that stands alone between other
    characters: a space begins the next unit, a line break is a unit of its own. Texts with any
    other white space, with white space in a row or at an end, are encoded whole, as are those
    that hold the text of a special token.

    The tokenizer would split units once more, between letters, digits and other characters.
    Where no token of its vocabulary spans such a border, its merges stop there by themselves,
    so units of ``_PLAIN`` characters go to the model at once; apostrophes, which begin splits
    of their own, do not belong to these.
    """

    def __init__(self, path: str, cached: int = CACHED):
        import os

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
        parts = json.loads(self.model.to_str())
        special = [x["content"] for x in parts["added_tokens"]]
        self.whole = [*spaces, "  ", " \n", "\n ", "\n\n", *special]
        self.line = np.array(self.model.encode("\n", add_special_tokens=False).ids, "<u4")
        self.cut = len(self.line) == 1
        self.sizes = _sizes(parts)
        if self.sizes is not None:
            self.bare = Tokenizer(self.model.model)
            self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        self.cached = cached
        self._clear()

    def _clear(self) -> None:
        """Forget all words. ``ids`` holds those of word after word; the n-th ends at ``ends[n + 1]``."""
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [] if not texts else [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without line breaks, one after the other, and their numbers: one text of all of them, cut at its line breaks."""
        if not units:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ids = np.array(self.model.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, "<u4")
        lines = ids == self.line[0]
        return ids[~lines], np.diff(np.flatnonzero(lines), prepend=-1, append=len(ids)) - 1

    def _plain_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_units``, for units of ``_PLAIN`` characters: cut where the tokens' bytes add up to a word's."""
        if not units:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        data = "\n".join(units).encode()
        codes = np.frombuffer(data, np.uint8)
        ids = np.array(self.bare.encode_batch_fast([_CODES[codes].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        breaks = np.flatnonzero(codes == 10)
        lengths = np.diff(breaks, prepend=-1, append=len(data)) - 1
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths)) + 1
        return ids, np.diff(stops, prepend=0)

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``, none of which is known."""
        units = [w[1:] if w[0] == "\n" else " " + w for w in words]
        plain = [self.sizes is not None and _PLAIN.fullmatch(u) is not None for u in units]
        for several, encode in ((True, self._plain_units), (False, self._units)):
            own = [w for w, p in zip(words, plain) if p is several]
            ids, numbers = encode([u for u, p in zip(units, plain) if p is several])
            after = np.array([w[0] == "\n" for w in own], bool)
            ids, numbers = np.insert(ids, (np.cumsum(numbers) - numbers)[after], self.line[0]), numbers + after
            first, at = len(self.known), self.ends[len(self.known)]
            self.known.update(zip(own, range(first, first + len(own))))
            self.ids, self.ends = _room(self.ids, at + len(ids)), _room(self.ends, first + len(own) + 1)
            self.ids[at:at + len(ids)] = ids
            self.ends[first + 1:first + len(own) + 1] = at + np.cumsum(numbers)

    def _simple(self, text: str) -> bool:
        return bool(text) and self.cut and text[0] not in " \n" and text[-1] not in " \n" and not any(map(text.__contains__, self.whole))

    def __call__(self, texts: list[str]) -> list[bytes]:
        simple = [self._simple(t) for t in texts]
        whole = iter(self._ids([t for t, s in zip(texts, simple) if not s]))
        words = iter(self._words([t for t, s in zip(texts, simple) if s]))
        return [next(words) if s else next(whole) for s in simple]

    def _words(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # A line break stays before the first word of its line; all other words follow a space.
        split = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.cached:
            # Frequent words come back with the next texts; rare ones would fill the cache for good.
            self._clear()
            fresh = words
        self._learn(fresh)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start, stop = self.ends[number], self.ends[number + 1]
        out, at = [], 0
        for n in pc.list_value_length(split).to_pylist():
            own = of[at:at + n]
            at += n
            a, z = start[own], stop[own]
            a[0] += 1  # no line break before the text
            count = z - a
            before = np.cumsum(count) - count
            out.append(self.ids[np.repeat(a - before, count) + np.arange(before[-1] + count[-1])].tobytes())
        return out


_PLAIN = re.compile(" ?[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
_SIGNS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_CODES = np.array([10 if b == 10 else ord(_SIGNS.get(b, chr(b))) for b in range(256)], "<u4")  # line breaks stay


def _sizes(parts: dict) -> np.ndarray | None:
    """Bytes of every token of a byte-level model whose merges span no border between letters, digits and others."""
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    usual = {"type": "BPE", "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
    if parts["normalizer"] or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
        return None
    if any(model.get(k) != v for k, v in usual.items()) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte = {chr(b): b for b in _SHOWN} | {sign: b for b, sign in _SIGNS.items()}
    if not byte.keys() <= model["vocab"].keys():
        return None
    border = re.compile("[A-Za-z\x80-\xff](?=[^A-Za-z\x80-\xff])|[0-9](?=[^0-9])|[^A-Za-z0-9\x80-\xff\\s](?=[A-Za-z0-9\x80-\xff])", re.ASCII)
    foreign = re.compile("['\xc0-\xc2\xca-\xff]|.\\s", re.ASCII | re.DOTALL)  # not in units of _PLAIN characters
    for merge in model["merges"]:
        token = "".join(chr(byte[c]) for c in ("".join(merge) if isinstance(merge, list) else merge.replace(" ", "")))
        if border.search(token) and not foreign.search(token):
            return None
    sizes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    for token, number in model["vocab"].items():
        sizes[number] = len(token)
    return sizes


def _room(numbers: np.ndarray, n: int) -> np.ndarray:
    return numbers if n <= len(numbers) else np.concatenate([numbers, np.zeros(max(n - len(numbers), len(numbers)), numbers.dtype)])


_encoders: dict[tuple[str, int], _Encoder] = {}


def _encoder(path: str, cached: int) -> _Encoder:
    if (path, cached) not in _encoders:
        _encoders[path, cached] = _Encoder(path, cached)
    return _encoders[path, cached]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = True,
                 cached: int = CACHED) -> DataFrame:
    """Pieces of every document: doc_id, piece (from 0), start (ids before it), length, ids_crc32, ids.

    A document is the ids of its text, with nothing added, then ``end``; an empty or null text
    is ``end`` alone. Only documents of more than ``capacity`` ids are cut: all pieces but the
    first are full. ``ids`` are little-endian unsigned 32-bit numbers, and ``ids_crc32`` is
    their checksum; without ``with_ids`` it stands for them and they stay where they were made.
    ``tokenizer`` is a file that every executor can open; a worker remembers the ids of
    ``cached`` words. An empty table gives no rows; repeated rows repeat pieces.
    """
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer, cached)
        for b in batches:
            for at in range(0, len(b["doc_id"]), TEXTS):
                texts = [t.decode("utf-8", "replace") for t in b["text"][at:at + TEXTS]]
                for doc, ids in zip(b["doc_id"][at:at + TEXTS], encode(texts)):
                    ids += last
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    ends = [first, *range(first + capacity, n + 1, capacity)]
                    for piece, (start, stop) in enumerate(zip([0, *ends], ends)):
                        own = ids[4 * start:4 * stop]
                        yield doc, piece, start, stop - start, zlib.crc32(own), *((own,) if with_ids else ())

    return mapped(whole_texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""), 4 * TEXTS)


class OpenBins:
    """At most ``limit`` open bins; a bitset holds the amounts of free space that occur.

    ``put`` returns the bin and offset of an item: the open bin with the least space that is
    enough, or a new one. A bin without space closes; when a new bin would exceed the limit,
    the fullest closes first.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 2048, per_task: int = PER_TASK) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless from 0 in each sequence.

    ``pieces`` has a length (1 to ``capacity``); other columns, of any type, pass through, but
    those called sequence_id and offset are replaced. A full piece is a sequence of its own.
    Of the others the lengths alone are dealt out evenly by a hash, ``per_task`` to a task, and
    packed in hash order, so a task that runs again repeats its result; their places are then
    joined to the pieces. Only ``open_bins`` free-space entries are held: memory grows neither
    with the input nor with what the pieces carry.
    """
    row, made = "__piece_row", ("sequence_id", "offset")
    placed = written(pieces.drop(*made).withColumn(row, F.monotonically_increasing_id()), "pieces")
    full = placed.filter(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.lit(FULL) + F.col(row), "offset": F.lit(0).cast("long")}
    )
    rest = placed.filter(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // per_task))
    light = rest.select(F.col(row).alias("row"), F.col("length").cast("long").alias("length"), F.xxhash64(row).alias("order"))
    dealt = light.repartition(tasks, "order").sortWithinPartitions("order", "row")

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            for number, length in zip(b["row"], b["length"]):
                sequence, offset = bins.put(length)
                yield number, base + sequence, offset

    places = written(mapped(dealt, run, f"{row} long, sequence_id long, offset long"), "places")
    columns = [F.col(f"`{c}`") for c in placed.columns if c != row]
    return rest.join(places, row).select(*columns, *made).unionByName(full.select(*columns, *made))

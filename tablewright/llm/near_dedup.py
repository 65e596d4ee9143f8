"""Near duplicates from bottom-k sketches.

One hash function orders the word shingles of all documents; a document's sketch is its ``k``
smallest values. Of two documents with similarity J or more, each of the k smallest values of
their union lies in both sketches with probability J, so nearly surely ``overlap`` of them do
(64 values at 0.8: all but one pair in ten million share 32). Inverted lists of retained
values therefore need only the rarest k - overlap + 1 values of each sketch: pairs that share
no such value share too few. Union sketches estimate the similarity of the rest, and whole
shingle sets decide.

Lists are not expanded into pairs. Documents with equal sets are one entry; each list ties its
entries to one of them, the one with the fewest values of its own, which finds almost all
links. Only entries of lists that then still hold several components meet pairwise, and of
those only pairs that have one of their rarest shingles in common, as similar ones must.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped, numbered, numbered_texts
from tablewright.llm.graph import components
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written

CACHED = 100_000  # words whose hashes a Python worker remembers
AT_ONCE = 500  # texts or sets that it holds
CLASS = 1.06  # upper over lower size of sets that meet in one list


@dataclass(frozen=True)
class Likeness:
    """Words per shingle, similarity in percent, values per sketch, and those in common that are sure."""

    words: int = 5
    percent: int = 80
    k: int = 64
    overlap: int = 32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHED:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles, as int64.

    A text of fewer words than ``width`` is one shingle, one without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    values = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(n, width)
    with np.errstate(over="ignore"):
        mixed = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ values[i:n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1)).view(np.int64)


def sketches(texts: DataFrame, how: Likeness) -> DataFrame:
    """row, doc_id, n_shingles, whole (a fingerprint of the set) and sketch, its smallest values."""

    def run(batches):
        for b in batches:
            for row, doc, text in zip(b["row"], b["doc_id"], b["text"]):
                own = shingle_set(text, how.words)
                yield row, doc, len(own), xxhash.xxh3_128_digest(own.tobytes()), own[:how.k].tolist()

    return mapped(texts, run, "row long, doc_id long, n_shingles long, whole binary, sketch array<bigint>", AT_ONCE)


def _entries(items: DataFrame, how: Likeness) -> DataFrame:
    """value, id, n, alone: the rarest values of each sketch that others share.

    ``alone`` counts the sketch's values that no other has. They are its rarest, so documents
    unlike all others end here.
    """
    values = items.select("id", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    by_id = values.join(shared, "value").groupBy("id", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"))
    sure = F.least(F.lit(how.overlap), F.ceil(F.col("n") * how.percent / 100))
    take = F.col("kept") - sure + 1 - (F.col("kept") - F.size("shared"))
    return by_id.withColumn("take", take.cast("int")).filter("take > 0").select(
        "id", "n", (F.col("kept") - F.size("shared")).alias("alone"), F.transform(F.slice("shared", F.lit(1), F.col("take")), lambda s: s["value"]).alias("prefix")
    )


def _alike(pairs: DataFrame, items: DataFrame, how: Likeness) -> DataFrame:
    """Pairs (a, b) that their sizes and the sketch of their union do not rule out."""
    a, b = (items.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("sketch").alias(f"s_{i}")) for i in "ab")
    both = pairs.join(b, "b").join(a, "a").filter(
        100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, how.k)
    common = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    return both.filter(common * how.k >= how.overlap * F.size(union)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, how: Likeness) -> DataFrame:
    """Pairs whose whole sets are similar enough."""

    def run(batches):
        for b in batches:
            for a, other, x, y in zip(b["a"], b["b"], b["x"], b["y"]):
                one, two = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= how.percent * (len(one) + len(two) - common):
                    yield a, other

    whole = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    whole = whole.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    return mapped(whole.select("a", "b", "x", "y"), run, "a long, b long", AT_ONCE)


def _groups(texts: DataFrame, how: Likeness) -> DataFrame:
    """Per row: row, doc_id, n_shingles, component_id and first_row, the row that stays for its component."""
    drawn = written(sketches(texts, how), "sketches")
    able = drawn.filter("n_shingles > 0")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = written(able.groupBy("whole").agg(
        F.min("row").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), smallest.alias("smallest"),
        F.count(F.lit(1)).alias("rows")), "shingle-classes")
    items = classes.select("id", "n", "sketch")
    heads = written(_entries(items, how), "sketch-heads")
    lists = heads.select("id", "n", "alone", F.explode("prefix").alias("value"))

    hubs = lists.groupBy("value").agg(F.min(F.struct("alone", "id")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    lists = written(lists.join(hubs.select("value", F.col("hub.id").alias("hub")), "value"), "sketch-lists")
    wanted = lists.select("id").distinct()

    def members(batches):
        for b in batches:
            for row, text in zip(b["row"], b["text"]):
                yield row, shingle_set(text, how.words).tobytes()

    sets = texts.select("row", "text").join(broadcast_if_small(written(wanted.withColumnRenamed("id", "row"), "set-ids")), "row", "left_semi")
    sets = written(mapped(sets, members, "id long, members binary", AT_ONCE), "shingle-sets")

    stars = lists.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_confirmed(_alike(stars, items, how), sets, how), "near-links")
    first = written(components(links), "near-components")
    more = _other_links(lists, first, sets, items, how)
    links = links.unionByName(more)
    found = components(links)

    tied = classes.join(found, F.col("id") == F.col("node"), "left").select("whole", "id", "rows", "smallest", "component")
    ends = tied.filter("component is not null").groupBy("component").agg(F.min("smallest").alias("reached"))
    tied = tied.join(ends, "component", "left").filter("component is not null or rows > 1")
    tied = written(tied.select("whole", F.coalesce("reached", "smallest").alias("reached")), "reached")
    joined = drawn.select("row", "doc_id", "n_shingles", "whole").join(broadcast_if_small(tied), "whole", "left")
    own = F.col("reached").isNull() | (F.col("n_shingles") == 0)
    return joined.select(
        "row", "doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("reached.doc_id")).alias("component_id"),
        F.when(own, F.col("row")).otherwise(F.col("reached.row")).alias("first_row"))


def near_groups(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, A-Z in lower case. Documents
    whose shingle sets have at least ``percent`` of their union in common are linked;
    ``component_id`` is the smallest doc_id that links reach, and that document is kept. Null,
    empty and blank texts have no shingles, link to nothing and are kept. Every row has its own
    text: rows that share a doc_id are linked by their texts alone. Rows without an id are
    linked too; ``component_id`` is null where no row that links reach has one. Shingles are
    told apart by 63-bit hashes. An empty table gives no rows.
    """
    found = _groups(numbered_texts(docs), how)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _other_links(lists: DataFrame, first: DataFrame, sets: DataFrame, items: DataFrame, how: Likeness) -> DataFrame:
    """Links between entries that share a list and are in different components of ``first``.

    Of two sets that are similar enough, some of the rarest shingles of each must meet, as too
    few would be left otherwise; how many of them follows from both sizes, so entries meet by
    shingle and class of sizes. Shingles are ordered by how many of these entries have them:
    what an edit made stands first and is met by nothing. A copy with more such shingles than
    partners of its size allow is in no list, and lists of one component are left out, so that
    the many unlike copies of one text stay apart without being paired.
    """
    placed = lists.join(first, lists.id == first.node, "left").select("value", "id", "n", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    able = written(placed.join(split.select("value"), "value", "left_semi").select("id", "n", "component").distinct(), "open-entries")

    def each(batches):
        for b in batches:
            for i, own in zip(b["id"], b["members"]):
                yield i, np.frombuffer(own, np.int64).tolist()

    own = sets.join(broadcast_if_small(able.select("id")), "id", "left_semi")
    shingles = mapped(own, each, "id long, shingles array<bigint>", AT_ONCE).select("id", F.explode("shingles").alias("shingle"))
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    by_id = shingles.join(shared, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    # Shingles that no other entry has come first in the order and take their places in it.
    by_id = by_id.join(broadcast_if_small(able), "id").withColumn("rest", F.size("shared"))

    def heads(entries: DataFrame, least: Column) -> DataFrame:
        """The shingles of which one is shared with every partner of ``least`` or more shingles."""
        length = (F.col("rest") - _needed(F.col("n"), least, how) + 1).cast("int")
        first = entries.withColumn("length", length).filter("length > 0")
        names = F.transform(F.slice("shared", F.lit(1), F.col("length")), lambda s: s["shingle"])
        return first.select("id", "n", "component", "rest", "sizes", F.posexplode(names).alias("at", "shingle"))

    n = F.col("n")
    lowest = F.ceil(n * how.percent / 100)
    smaller = heads(by_id.withColumn("sizes", _size_class(n)), n)
    classes = F.sequence(_size_class(lowest), _size_class(n))
    larger = heads(by_id.withColumn("sizes", F.explode(classes)), F.greatest(lowest, F.floor(F.pow(F.lit(CLASS), "sizes")) - 1))
    both = written(smaller.withColumn("small", F.lit(True)).unionByName(larger.withColumn("small", F.lit(False))), "open-heads")
    mixed = both.groupBy("shingle", "sizes").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    both = written(both.join(mixed.select("shingle", "sizes"), ["shingle", "sizes"], "left_semi"), "mixed-heads")
    a, b = both.filter("small").alias("a"), both.filter("not small").alias("b")
    needed = _needed(F.col("a.n"), F.col("b.n"), how)
    pairs = a.join(b, (
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.sizes") == F.col("b.sizes")) & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))))
        & (F.col("a.rest") - F.col("a.at") >= needed) & (F.col("b.rest") - F.col("b.at") >= needed)
    )).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return written(_confirmed(_alike(written(pairs, "open-pairs"), items, how), sets, how), "near-links")


def _needed(n: Column, other: Column, how: Likeness) -> Column:
    """Shingles that sets of these sizes must have in common to be similar enough."""
    return F.ceil((n + other) * how.percent / (100 + how.percent))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(CLASS)).cast("int")


def drop_near(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """One row of each component, with the columns it came with: that of the smallest doc_id, nulls last."""
    docs, row, texts = numbered(docs)
    gone = written(_groups(texts, how).filter("row <> first_row").select(F.col("row").alias(row)), "near-copies")
    return docs.join(broadcast_if_small(gone), row, "left_anti").drop(row)

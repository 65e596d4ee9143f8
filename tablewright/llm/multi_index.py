"""Nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantization) turns
every vector into a binary code. Codes are split into substrings and every substring is an
index key. A code within Hamming radius r of the query's agrees with it, in one of m
substrings, up to r // m bits, so probing those values finds every code within r. Further
rotations make a longer code whose Hamming distance tells nearness more sharply: of what the
index retrieves, only rows within a second radius on all bits are looked up, and the original
vectors give their exact distances.

The index is built by blocks of vectors, and each block meets each block of queries in a task:
what is probed and what is retrieved stays there, so the driver's memory does not grow with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from tablewright.llm.common import mapped, ship
from tablewright.operators.ranking import nth_smallest
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written

SAMPLE = 20_000  # vectors from which the rotation and the radius are learned
TRIALS = 256  # of them, those that try the radius
SUBSTRING = 11  # bits at most
TURNS = 4  # rotations; the first makes the indexed code, all of them the longer one
BLOCK = ["ids", "copies", "shared", "code", "x"]  # arrays that a block of vectors consists of
BLOCK_BYTES, ASKED_BYTES = 16 << 20, 2 << 20  # of vectors as doubles, in a block of the index and of queries
JOINED_BYTES = 16 << 20  # most of a broadcast side, as the driver holds two at once
KEPT = (0.99, 0.96)  # shares of the sample's true neighbours within the radii of both codes


@dataclass(frozen=True)
class Codes:
    """x -> sign((x - mean) @ rotation), ``bits`` at a time; substrings of the first of these
    as bit masks; and the radii on the indexed and on the longer code."""

    mean: np.ndarray
    rotation: np.ndarray
    masks: tuple[int, ...]
    radius: int
    whole_radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1] // TURNS

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of the vectors in the rows of ``x``, a row of numbers per rotation."""
        places = np.left_shift(np.uint64(1), np.arange(self.bits, dtype=np.uint64))
        signs = (x - self.mean) @ self.rotation > 0
        return np.stack([(part * places).sum(1, dtype=np.uint64) for part in np.split(signs, TURNS, axis=1)])

    def limits(self, radius: int) -> list[int]:
        """Differing bits to allow in each substring, -1 for none: they cover the radius."""
        each, more = divmod(radius, len(self.masks))
        return [each if i <= more else each - 1 for i in range(len(self.masks))]


def learn_codes(sample: np.ndarray, neighbours: int, seed: int = 1) -> Codes:
    """Codes of at most 64 bits a rotation from a sample of vectors, one per row."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    bits = min(64, sample.shape[1])
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    reduced = centred @ axes
    turns = []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(30):
            u, _, v = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
            turn = (u @ v).T
        turns.append(axes @ turn)
    rotation = np.hstack(turns)
    parts = np.array_split(np.arange(bits), -(-bits // SUBSTRING))
    masks = tuple(sum(1 << int(i) for i in p) for p in parts)
    signs = centred @ rotation > 0
    apart = []
    for i in rng.permutation(len(sample))[:TRIALS]:
        far = ((sample - sample[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argsort(far)[:min(neighbours, len(sample) - 1)]
        differ = signs[near] != signs[i]
        apart += zip(differ[:, :bits].sum(1), differ.sum(1))
    if not apart:
        return Codes(mean, rotation, masks, bits, TURNS * bits)
    radii = [int(np.quantile(values, share)) for values, share in zip(zip(*apart), KEPT)]
    return Codes(mean, rotation, masks, *radii)


def stored(vectors: DataFrame, vector: str = "embedding") -> str:
    """Numpy's name of the numbers by which vectors are kept: floats as they are, all others as doubles."""
    return "f4" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "f8"


def usable_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, n and x, the vector's length and bytes as ``stored``, of the vectors that take part.

    Vectors that are null, zero, or hold a null, infinite or not-a-number component do not.
    """
    kind = stored(vectors, vector)
    fields = pa.schema([("vec_id", pa.int64()), ("n", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            lists = b["v"]
            ends = lists.offsets.to_numpy()
            numbers = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # null components become not-a-number
            odd, some = (np.concatenate([[0], np.cumsum(c)]) for c in (~np.isfinite(numbers), numbers != 0))
            kept = np.flatnonzero((odd[ends[1:]] == odd[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False))
            x = [numbers[i:j].tobytes() for i, j in zip(ends[kept].tolist(), ends[kept + 1].tolist())]
            yield pa.record_batch([b["vec_id"].take(pa.array(kept)), pa.array(np.diff(ends)[kept], pa.int32()), pa.array(x, pa.binary())], schema=fields)

    ship(vectors.sparkSession)
    numbers = F.col(vector).cast("array<float>" if kind == "f4" else "array<double>")
    return written(vectors.select(F.col("vec_id").cast("long"), numbers.alias("v")).mapInArrow(run, "vec_id long, n int, x binary"), "vectors")


def _sample(entries: DataFrame, kind: str = "f8") -> np.ndarray:
    """The ``SAMPLE`` entries with the least hashes of their ids, in this order.

    Found by counts and cut on an executor: a collected limit brings the driver that many rows of every task.
    """
    hashed = entries.select(F.xxhash64("vec_id").alias("hash"), "vec_id", "x")
    if hashed.count() > SAMPLE:
        hashed = hashed.filter(F.col("hash") <= nth_smallest(hashed, "hash", SAMPLE, scanned=False)[0])
    first = written(hashed.orderBy("hash", "vec_id", "x").limit(SAMPLE), "vector-sample").collect()
    first.sort(key=lambda r: (r.hash, r.vec_id is not None, r.vec_id or 0, bytes(r.x)))
    return np.stack([np.frombuffer(r.x, kind) for r in first]).astype(float)


def _packed(rows: DataFrame, codes: Codes, most_bytes: int, kind: str) -> DataFrame:
    """Rows of vec_id, copies, shared and x as blocks of a partition's rows, with their codes, as bytes of arrays."""
    length = len(codes.mean)
    most = max(1, most_bytes // (8 * length))

    def block(held):
        ids, copies, shared, x = zip(*held)
        x = b"".join(x)
        code = codes.of(np.frombuffer(x, kind).reshape(-1, length).astype(float))
        return np.array(ids, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), np.array(shared, bool).tobytes(), code.tobytes(), x

    def run(batches):
        held = []
        for b in batches:
            for row in zip(b["vec_id"], b["copies"], b["shared"], b["x"]):
                held.append(row)
                if len(held) == most:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return mapped(rows.select("vec_id", "copies", "shared", "x"), run, ", ".join(f"{c} binary" for c in BLOCK))


class _Index:
    """A block of codes, indexed by each substring: ``met`` gives the rows that agree with a
    code, in one substring, up to its limit of differing bits.

    What a substring's value meets is kept as bits, for other codes with that value.
    """

    def __init__(self, codes: Codes, limits: list[int], code: np.ndarray):
        self.rows, self.parts = len(code), []
        for mask, most in zip(codes.masks, limits):
            shift = (mask & -mask).bit_length() - 1
            low = mask >> shift
            width = low.bit_length()
            chosen = (c for n in range(min(most, width) + 1) for c in combinations(range(width), n))
            changes = np.array([sum(1 << i for i in c) for c in chosen], np.int64)
            value = ((code >> np.uint64(shift)) & np.uint64(low)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << width) + 1))
            self.parts.append((shift, low, changes, order, starts, {}))

    def met(self, code: int) -> np.ndarray:
        found = np.zeros(-(-self.rows // 8), np.uint8)
        for shift, low, changes, order, starts, known in self.parts:
            own = code >> shift & low
            if own not in known:
                probed = own ^ changes
                first = starts[probed]
                size = starts[probed + 1] - first
                ends = np.cumsum(size)
                hit = np.zeros(self.rows, bool)
                if len(ends):
                    hit[order[np.repeat(first - ends + size, size) + np.arange(ends[-1])]] = True
                known[own] = np.packbits(hit)
            found |= known[own]
        return np.unpackbits(found, count=self.rows).view(bool)


def _within(index: DataFrame, asked: DataFrame, codes: Codes, radius: int, whole_radius: int, kept: int, kind: str) -> DataFrame:
    """Index rows whose codes are within the radii of a query's: query, vec_id, score, whole, copies.

    Every block of the index meets every block of queries where it is: neither the probed
    values nor the rows found are sent anywhere. Of a block's rows within the radii a query
    gets the ``kept`` nearest; all of them, with ``whole``, where a row or the query shares its id
    with another vector. ``copies`` adds up to those of all rows within the radii.
    """
    limits, length = codes.limits(radius), len(codes.mean)

    def run(batches):
        seen = None
        for b in batches:
            for block in zip(*(b[c] for c in BLOCK), *(b[f"asked_{c}"] for c in BLOCK)):
                ids, queries = np.frombuffer(block[0], np.int64), np.frombuffer(block[5], np.int64)
                copies, shared, asked_shared = np.frombuffer(block[1], np.int64), np.frombuffer(block[2], bool), np.frombuffer(block[7], bool)
                code, asked_code = (np.frombuffer(block[i], np.uint64).reshape(TURNS, -1) for i in (3, 8))
                x, y = (np.frombuffer(block[i], kind).reshape(-1, length) for i in (4, 9))
                if block[3] != seen:
                    seen, found = block[3], _Index(codes, limits, code[0])
                for at, query in enumerate(queries.tolist()):
                    apart = np.bitwise_count(code[0] ^ asked_code[0, at])
                    near = np.flatnonzero(found.met(int(asked_code[0, at])) & (apart <= radius))
                    apart = apart[near].astype(np.int64)
                    for turn in range(1, TURNS):
                        apart += np.bitwise_count(code[turn, near] ^ asked_code[turn, at])
                    near = near[apart <= whole_radius]
                    if not len(near):
                        continue
                    held = int(copies[near].sum())
                    score = np.sqrt(((y[at].astype(float) - x[near]) ** 2).sum(1))
                    whole = shared[near] | asked_shared[at]
                    alone = np.flatnonzero(~whole)
                    if len(alone) > kept:
                        alone = alone[score[alone] <= np.partition(score[alone], kept - 1)[kept - 1]]
                        alone = alone[np.lexsort((ids[near[alone]], score[alone]))[:kept]]
                    chosen = np.concatenate([alone, np.flatnonzero(whole)])
                    for row in zip(ids[near[chosen]].tolist(), score[chosen].tolist(), whole[chosen].tolist()):
                        yield query, *row, held
                        held = 0

    # The hint rules out a broadcast, whatever the session's threshold.
    both = index.crossJoin(asked.select(*(F.col(c).alias(f"asked_{c}") for c in BLOCK)).hint("shuffle_replicate_nl"))
    return mapped(both, run, "query long, vec_id long, score double, whole boolean, copies long", at_once=1)


def nearest(vectors: DataFrame, queries: Column, neighbours: int = 10, vector: str = "embedding") -> DataFrame:
    """Each query's nearest other rows found: query_id, rank (from 1), vec_id, score.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.
    ``queries`` is a condition on vec_id. Equal vectors are one index entry whose smallest
    ``neighbours + 1`` ids stand for all, as no others can be among the nearest. A query whose
    radii hold too few rows is asked again with greater ones, at last over all codes, so
    every query gets ``neighbours`` rows or all others. Rows that repeat a vec_id and vector
    count once. Vectors of each length have an index of their own, as only they have a
    distance. An empty table, or one without usable vectors, gives no rows.
    """
    usable = usable_vectors(vectors, vector)
    lengths = [r.n for r in usable.select("n").distinct().orderBy("n").collect()]
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        found = found.unionByName(_nearest(usable.filter(F.col("n") == n).select("vec_id", "x"), queries, neighbours, stored(vectors, vector)))
    return found


def _nearest(usable: DataFrame, queries: Column, neighbours: int, kind: str) -> DataFrame:
    """``nearest`` for usable vectors of one length, at least one."""
    usable = usable.dropDuplicates()
    by_vector = Window.partitionBy("x").orderBy("vec_id")
    members = usable.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= neighbours + 1)
    members = written(members.withColumn("entry", F.first("vec_id").over(by_vector)), "vector-members")
    entries = members.filter("place = 1").select("vec_id", "x")
    codes = learn_codes(_sample(entries, kind), neighbours)
    copies = members.groupBy(F.col("entry").alias("vec_id")).agg(F.count(F.lit(1)).alias("copies"), (F.count_if(F.col("place") == 1) > 1).alias("shared"))
    copies = written(copies.filter("copies > 1 or shared"), "vector-copies")
    rows = entries.filter("vec_id is not null").join(broadcast_if_small(copies, JOINED_BYTES), "vec_id", "left").fillna({"copies": 1, "shared": False})
    index = written(_packed(rows, codes, BLOCK_BYTES, kind), "vector-index")
    asking = written(usable.filter(queries).select(F.col("vec_id").alias("query_id"), "x"), "vector-queries")
    # Equal queries are asked once.
    asked = asking.groupBy("x").agg(F.min("query_id").alias("query"))
    shared = written(asked.groupBy("query").agg((F.count(F.lit(1)) > 1).alias("shared")).filter("shared"), "vector-shared")
    pending = written(asked.join(broadcast_if_small(shared, JOINED_BYTES), "query", "left").fillna({"shared": False}), "vector-asked")
    everything = members.count()
    need = min(neighbours + 1, everything)
    radius, whole_radius, done = codes.radius, codes.whole_radius, None

    def far(batches):
        for b in batches:
            if b["x"]:
                x, y = (np.frombuffer(b"".join(b[c]), kind).reshape(len(b["x"]), -1).astype(float) for c in ("x", "y"))
                yield from zip(b["query"], b["entry"], np.sqrt(((x - y) ** 2).sum(1)).tolist())

    best = Window.partitionBy("query").orderBy("score", "vec_id")
    while True:
        if radius >= codes.bits:
            radius, whole_radius = codes.bits, TURNS * codes.bits
        rows = pending.filter("query is not null").select(F.col("query").alias("vec_id"), F.lit(1).alias("copies"), "shared", "x")
        blocks = written(_packed(rows, codes, ASKED_BYTES, kind), "vector-asked-blocks")
        pairs = written(_within(index, blocks, codes, radius, whole_radius, neighbours + 1, kind), "vector-candidates")
        held = pairs.groupBy("query").agg(F.sum("copies").alias("held"))
        full = written(held.filter(F.col("held") >= need).select("query"), "vector-answered")
        answered = pairs.join(broadcast_if_small(full, JOINED_BYTES), "query", "left_semi") if radius < codes.bits else pairs
        first = answered.filter("not whole").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= neighbours + 1).drop("n")
        chosen = written(first.unionByName(answered.filter("whole")).select("query", F.col("vec_id").alias("entry")), "vector-chosen")
        rows = (
            entries.select(F.col("vec_id").alias("entry"), F.col("x").alias("y"))
            .join(broadcast_if_small(chosen, JOINED_BYTES), "entry")
            .join(broadcast_if_small(pending.select("query", "x"), JOINED_BYTES), "query")
        )
        scored = mapped(rows.select("query", "entry", "x", "y"), far, "query long, entry long, score double")
        # First the nearest entries, then their ids: an entry never stands in for a nearer one.
        near = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))).filter(F.col("n") <= neighbours + 1)
        top = near.join(members.select("entry", "vec_id"), "entry").withColumn("n", F.row_number().over(best))
        top = written(top.filter(F.col("n") <= neighbours + 1).select("query", "vec_id", "score"), "vector-nearest")
        done = top if done is None else done.unionByName(top)
        pending = written(pending.join(full, "query", "left_anti"), "vector-asked")
        if radius == codes.bits or pending.isEmpty():
            break
        radius, whole_radius = radius + 8, whole_radius + 8 * TURNS
    own = asking.join(asked, "x").select("query_id", "query")
    listed = own.join(done, "query").filter("vec_id <> query_id")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

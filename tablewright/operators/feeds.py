"""Change feeds: numbered batches that mix new rows with updates of recent ones.

Rows carry a 1-based index. Batch 0 inserts rows 1..R. Each later batch inserts the next I
rows and sends the U rows before those again, as updates; I + U = R, so every batch has R
rows. All batches come from one pass: which batches a row belongs to follows from its index
alone, and which row a batch holds at a place follows from the place, so there is no join, no
per-batch scan and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.scalars import batch_suffix, blank, external_id
from tablewright.operators.filters import index_between, stacked

INSERT, UPDATE = "I", "U"
ROWS_PER_TASK = 2_000_000  # of generated rows


class ObjectType(str, Enum):
    """How the receiving table treats rows. Fixed values."""

    STANDARD = "standard"
    STANDARD_WITH_EXTERNAL_ID = "standard_with_external_id"
    STANDARD_BITEMPORAL = "standard_bitemporal"
    VERSIONED_BITEMPORAL = "versioned_bitemporal"
    STANDARD_TRANSACTIONAL = "standard_transactional"
    VERSIONED_TRANSACTIONAL = "versioned_transactional"
    COMPLETE_SNAPSHOT = "complete_snapshot"
    INCREMENTAL_SNAPSHOT = "incremental_snapshot"

    @property
    def has_external_id(self) -> bool:
        return self in (
            ObjectType.STANDARD_WITH_EXTERNAL_ID,
            ObjectType.STANDARD_BITEMPORAL,
            ObjectType.VERSIONED_BITEMPORAL,
        )

    @property
    def has_candidate_key(self) -> bool:
        return not self.has_external_id and self is not ObjectType.STANDARD


@dataclass(frozen=True)
class FeedSpec:
    """Shape of a feed; refused at construction when it cannot be produced."""

    object_name: str
    object_type: ObjectType
    batches: int
    rows_per_batch: int
    inserts: int
    updates: int
    candidate_keys: tuple[str, ...] = ()
    amount: str = "TOTAL_AMOUNT"

    def __post_init__(self) -> None:
        object.__setattr__(self, "object_type", ObjectType(self.object_type))
        if not self.object_name:
            raise ValueError("object_name is required")
        if self.batches < 1 or self.rows_per_batch < 1 or self.inserts < 0 or self.updates < 0:
            raise ValueError("batches and rows_per_batch must be positive, inserts and updates not negative")
        if self.inserts + self.updates != self.rows_per_batch:
            raise ValueError("inserts + updates must equal rows_per_batch")
        if self.object_type.has_candidate_key and not any(k.strip() for k in self.candidate_keys):
            raise ValueError(f"{self.object_type.value} needs candidate keys")

    @property
    def pool_rows(self) -> int:
        """Rows that appear in the feed at all."""
        return self.rows_per_batch + (self.batches - 1) * self.inserts

    @property
    def feed_rows(self) -> int:
        return self.batches * self.rows_per_batch

    @property
    def id_column(self) -> str | None:
        if self.object_type is ObjectType.STANDARD:
            return f"{self.object_name}_id"
        return f"{self.object_name}_external_id" if self.object_type.has_external_id else None

    def insert_range(self, batch: int) -> tuple[int, int]:
        """Inclusive index range of the rows that ``batch`` inserts."""
        if batch == 0:
            return 1, self.rows_per_batch
        first = self.rows_per_batch + (batch - 1) * self.inserts + 1
        return first, first + self.inserts - 1

    def update_range(self, batch: int) -> tuple[int, int]:
        """Inclusive index range of the rows that ``batch`` updates; empty for batch 0."""
        if batch == 0:
            return 1, 0
        last = self.insert_range(batch)[0] - 1
        return last - self.updates + 1, last

    @classmethod
    def fitting(cls, rows: int, object_name: str, object_type: ObjectType | str, **options) -> FeedSpec:
        """Five batches that use a pool of ``rows`` whole: 2/13 of it new in each later batch."""
        inserts = rows * 2 // 13
        per_batch = max(1, rows - 4 * inserts)
        return cls(object_name, ObjectType(object_type), 5, per_batch, inserts, per_batch - inserts, **options)


def first_batch(index: Column, spec: FeedSpec) -> Column:
    """The batch that inserts a row."""
    past_seed = index - F.lit(spec.rows_per_batch)
    if spec.inserts == 0:
        return F.when(past_seed <= 0, F.lit(0)).cast("int")
    steps = F.call_function("div", past_seed + F.lit(spec.inserts - 1), F.lit(spec.inserts))
    return F.when(past_seed <= 0, F.lit(0)).otherwise(steps).cast("int")


def last_batch(index: Column, spec: FeedSpec) -> Column:
    """The last batch that holds a row; the batches in between all update it."""
    final = F.lit(spec.batches - 1)
    first = first_batch(index, spec)
    if spec.updates == 0:
        return first
    lag = index - F.lit(spec.rows_per_batch - spec.updates + 1)
    if spec.inserts == 0:
        return F.when(lag >= 0, final).otherwise(first).cast("int")
    reach = F.call_function("div", lag, F.lit(spec.inserts)) + 1
    return F.when(lag >= 0, F.greatest(first, F.least(final, reach))).otherwise(first).cast("int")


def change_feed(rows: DataFrame, index: str, spec: FeedSpec, start: int = 1, keep_index: bool = False,
                complete: bool = False) -> DataFrame:
    """All batches of a feed: the row's columns, its id if the type has one, ``batch``, ``op``.

    ``index`` numbers the rows consecutively from ``start``. The pool is cut by comparing the
    column itself with literals, so the cut reaches the scan. ``keep_index`` leaves the
    column in the result, for when it is data as well. A pool that does not hold every index
    once is refused, after one aggregate over the index column; ``complete`` leaves that out
    for indexes that are dense by construction. So are columns named ``batch`` or ``op``.
    """
    _refuse_clash(rows, spec)
    if not complete:
        require_pool(rows, index, spec, start)
    pool = index_between(rows, index, start, start + spec.pool_rows - 1)
    position = index_position(index, start)
    span = F.sequence(first_batch(position, spec), last_batch(position, spec))
    placed = pool.withColumn("batch", F.explode(span)).withColumn(
        "op", F.when(F.col("batch") == first_batch(position, spec), F.lit(INSERT)).otherwise(F.lit(UPDATE))
    )
    return shaped(placed, index, spec, start, keep_index)


def feed_slots(spark: SparkSession, spec: FeedSpec, partitions: int | None = None) -> DataFrame:
    """Every row of a feed as batch, op and the 1-based ``position`` of its row in the pool.

    The inverse of ``first_batch`` and ``last_batch``: row number n of the feed is in batch
    n div R; its place there says whether it is one of the batch's inserts or of the rows sent
    before them. So a feed whose cells follow from the position is made in the order of its
    batches, and a task touches few of them.
    """
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-spec.feed_rows // ROWS_PER_TASK))
    size, new = F.lit(spec.rows_per_batch).cast("long"), F.lit(spec.inserts).cast("long")
    batch, place = F.call_function("div", F.col("id"), size), F.col("id") % size
    is_insert = (batch == 0) | (place < new)
    before = F.when(batch == 0, F.lit(0).cast("long")).otherwise(size + (batch - 1) * new)
    position = before + place + 1 - F.when(is_insert, F.lit(0).cast("long")).otherwise(size)
    return spark.range(0, spec.feed_rows, 1, partitions).select(
        batch.cast("int").alias("batch"), F.when(is_insert, F.lit(INSERT)).otherwise(F.lit(UPDATE)).alias("op"), position.alias("position"),
    )


def batch_by_ranges(rows: DataFrame, index: str, spec: FeedSpec, batch: int, start: int = 1,
                    keep_index: bool = False) -> DataFrame:
    """One batch of the feed from its two index ranges, for when only that batch is wanted.

    The ranges are literals and reach the scan as pushed-down filters.
    """
    _refuse_clash(rows, spec)
    sides = []
    for op, (first, last) in ((INSERT, spec.insert_range(batch)), (UPDATE, spec.update_range(batch))):
        if last >= first:
            side = index_between(rows, index, first + start - 1, last + start - 1)
            placed = side.withColumns({"batch": F.lit(batch), "op": F.lit(op)})
            sides.append(shaped(placed, index, spec, start, keep_index))
    return stacked(sides)


def _refuse_clash(rows: DataFrame, spec: FeedSpec) -> None:
    made = {"batch", "op", *([spec.id_column] if spec.id_column else [])}
    clash = sorted(made & {c.lower() for c in rows.columns})
    if clash:
        raise ValueError(f"the feed makes columns of these names itself: {clash}")


def require_pool(rows: DataFrame, index: str, spec: FeedSpec, start: int = 1) -> int:
    """Raise unless the pool holds every index the feed needs, each once; returns how many.

    Rows are counted, and their indexes marked in bitmaps of 64 consecutive indexes, which
    every map task combines before the shuffle: as many rows as indexes as the feed needs.
    """
    position = F.col(index).cast("long") - F.lit(start).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (position % 64).cast("int"))
    marked = index_between(rows, index, start, start + spec.pool_rows - 1).groupBy(
        F.call_function("div", position, F.lit(64).cast("long")).alias("word")
    ).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    found, known = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0))).first()
    if not found == known == spec.pool_rows:
        raise ValueError(
            f"the feed needs {spec.pool_rows} rows with the indexes from {start} on, each once; found {found} rows with {known} indexes"
        )
    return known


def index_position(index: str, start: int) -> Column:
    """1-based position of a row in the pool."""
    value = F.col(index).cast("long")
    return value if start == 1 else value + F.lit(1 - start).cast("long")


def shaped(placed: DataFrame, index: str, spec: FeedSpec, start: int, keep_index: bool) -> DataFrame:
    """Give placed rows the columns that the object type prescribes."""
    hidden = {"batch", "op"} if keep_index else {index, "batch", "op"}
    payload = [name for name in placed.columns if name not in hidden]
    is_insert, is_later = F.col("op") == INSERT, F.col("batch") > 0
    cells = {name: F.col(f"`{name}`") for name in payload}
    if spec.object_type.has_candidate_key:
        for key in (k.strip() for k in spec.candidate_keys if k.strip()):
            cells[key] = F.when(is_insert & is_later, cells[key] + F.lit(1)).otherwise(cells[key])
        cells[spec.amount] = F.when(is_insert, cells[spec.amount]).otherwise(cells[spec.amount] + F.lit(1))
    elif spec.object_type is ObjectType.STANDARD:
        cells[spec.id_column] = F.when(is_insert, blank()).otherwise(index_position(index, start).cast("string"))
    else:
        cells[spec.id_column] = external_id(index_position(index, start))
    return placed.select(*[cell.alias(name) for name, cell in cells.items()], "batch", "op")


def file_name(batch: Column, spec: FeedSpec) -> Column:
    """``{object}_{rows}_{000}``, the name of a batch's file."""
    return F.concat(F.lit(f"{spec.object_name}_{spec.rows_per_batch}_"), batch_suffix(batch))


def batch_counts(feed: DataFrame) -> DataFrame:
    """Rows per batch and operation."""
    return feed.groupBy("batch", "op").agg(F.count(F.lit(1)).alias("rows"))

"""Applying batches to keyed tables. Each operator is DataFrame in, DataFrame out.

A key that holds a large share of all rows must not end up in one task. Where only one row
per key survives, the map side drops the others before the shuffle. Where all rows survive,
rows are cut into bounded pieces (``versions``) or frequent keys are kept out of the
shuffle altogether (``classify``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablewright.operators import sizes
from tablewright.operators.checks import require_count
from tablewright.operators.sizes import broadcast_if_small, content_bytes
from tablewright.session import written

BATCHES_PER_PIECE = 4_096  # rows that are put in order together
HOT_ROWS = 2_000_000
ROWS_AT_LEAST, ROWS_AT_MOST = 50_000, 2_000_000  # per range, when rows are numbered


def append_rows(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Transactional tables keep every row: union-all by name, no key check."""
    return table.unionByName(batch, allowMissingColumns=True)


def _tie_break(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """Total order over the other columns, so equal (key, batch) rows resolve the same way every run."""
    return [F.col(f"`{name}`").desc_nulls_last() for name in df.columns if name not in set(used)]


def latest_per_key(df: DataFrame, keys: Sequence[str], batch: str = "batch") -> DataFrame:
    """The row of the greatest batch for each key. Rows with a NULL key are nobody's version: all stay.

    Spark plans the rank filter with a per-key limit before the shuffle, so every map task
    sends at most one row per key, however often the key occurs.
    """
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    return _latest(df.filter(~no_key), keys, batch).unionByName(df.filter(no_key))


def _latest(df: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(batch).desc_nulls_last(), *_tie_break(df, [*keys, batch]))
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)


def upsert(table: DataFrame | None, feed: DataFrame, keys: Sequence[str], batch: str = "batch",
           follows: bool = False) -> DataFrame:
    """Insert new keys, replace known ones. ``table`` carries its own ``batch`` column.

    Say ``follows`` when the table holds each key once and all the feed's batches come after
    it, as when one batch after the other is applied. Then table rows are never ranked, only
    those with a changed key are left out, and while the changed keys are small enough to
    broadcast (they are measured first) the table is not shuffled at all. Beyond that only rows
    between the least and the greatest changed value of the first key are shuffled; the bounds
    reach the scan, so files of a table that is stored in key order are skipped on either side.
    """
    if table is None:
        return latest_per_key(feed, keys, batch)
    if not follows:
        return latest_per_key(table.unionByName(feed, allowMissingColumns=True), keys, batch)
    newest = written(latest_per_key(feed, keys, batch), "changed-rows")
    names = [f"__k{i}" for i in range(len(keys))]
    changed = newest.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    same = [F.col(k) == F.col(n) for k, n in zip(keys, names)]
    if content_bytes(changed) <= sizes.BROADCAST_BYTES:
        kept = table.join(F.broadcast(changed), same, "left_anti")
    else:
        low, high = changed.agg(F.min(names[0]), F.max(names[0])).first()
        key = F.col(keys[0])
        if low is None:  # rows without key replace nothing
            kept = table
        else:
            aside = table.filter((key < F.lit(low)) | (key > F.lit(high)) | key.isNull())
            kept = aside.unionByName(table.filter((key >= F.lit(low)) & (key <= F.lit(high))).join(changed, same, "left_anti"))
    return kept.unionByName(newest, allowMissingColumns=True)


def merge_snapshot(table: DataFrame | None, feed: DataFrame, candidate_keys: Sequence[str],
                   batch: str = "batch", follows: bool = False) -> DataFrame:
    """Incremental snapshot: the newest row per candidate key, older keys kept."""
    return upsert(table, feed, candidate_keys, batch, follows)


def replace_snapshot(feed: DataFrame, batch: str = "batch") -> DataFrame:
    """Complete snapshot: only the last batch counts.

    Its number is found first and becomes a literal, so a feed partitioned by batch reads
    one partition.
    """
    last = feed.agg(F.max(batch)).first()[0]
    return feed.filter(F.col(batch) == F.lit(last))


def _ranges(df: DataFrame, rows: int) -> int:
    """Partitions for numbering so many rows: few for few rows, bounded ones for many."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-rows // ROWS_AT_LEAST), max(usual, -(-rows // ROWS_AT_MOST))))


def dense_ids(df: DataFrame, order: Sequence[str], column: str, start: int = 1,
              partitions: int | None = None) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the given order, without a table-wide window.

    ``df`` is computed once, into a written copy whose rows are counted on the way. The copy
    is range-partitioned, into as many parts as its rows need unless ``partitions`` says, and
    sorted within partitions, then written with partition and position. An id is the rows in
    earlier partitions plus the position. Ties in the order are broken by the row's hash and
    then by its place in the copy, so copies of one row spread over several ranges too. The
    second copy pins the numbering: retries and later reads see the same ids.
    """
    spark = df.sparkSession
    ties, part, place = ["__tie", "__copy"], "__part", "__place"
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    seen = Observation()
    copy = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), "unnumbered")
    rows = int(seen.get["rows"])
    count = partitions or _ranges(df, rows)
    tied = copy.withColumns(dict(zip(ties, [row_hash, F.monotonically_increasing_id()])))
    if count > 1:
        tied = tied.repartitionByRange(count, *order, *ties)
    else:
        tied = tied.coalesce(1)  # so few rows that one task sorts them
    ranged = tied.sortWithinPartitions(*order, *ties).drop(*ties)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pinned = written(ranged.withColumns({part: F.spark_partition_id(), place: position}), "dense-ids")
    offsets, next_id = [], start
    for number, size in sorted(pinned.groupBy(part).count().collect()):  # one row per partition
        offsets.append((number, next_id))
        next_id += size
    require_count(rows, next_id - start, "numbered rows")
    if not offsets:
        return pinned.withColumn(column, F.lit(None).cast("long")).drop(part, place)
    base = spark.createDataFrame(offsets, f"{part} int, __base long")
    return (
        pinned.join(F.broadcast(base), part)
        .withColumn(column, F.col("__base") + F.col(place))
        .drop(part, place, "__base")
    )


def assign_ids(table: DataFrame | None, feed: DataFrame, id_column: str, order: Sequence[str],
               batch: str = "batch", follows: bool = False) -> DataFrame:
    """Standard tables own their ids: a blank id is a new row, a number replaces that row.

    New ids continue above the table's greatest, in (batch, order). The id comes back as a
    long, and the result holds the newest row of every id. ``follows`` as for ``upsert``.
    """
    text = F.trim(F.col(id_column).cast("string"))
    is_new = F.coalesce(text == "", F.lit(True))
    top = 0 if table is None else table.agg(F.max(F.col(id_column).cast("long"))).first()[0] or 0
    fresh = dense_ids(feed.filter(is_new).drop(id_column), [batch, *order], id_column, top + 1)
    known = feed.filter(~is_new).withColumn(id_column, F.col(id_column).cast("long"))
    held = None if table is None else table.withColumn(id_column, F.col(id_column).cast("long"))
    return upsert(held, known.unionByName(fresh), [id_column], batch, follows)


def versions(feed: DataFrame, keys: Sequence[str], batch: str = "batch", batches: int | None = None,
             unique: bool = False, piece: int = BATCHES_PER_PIECE) -> DataFrame:
    """Bitemporal and versioned tables: every (key, batch) with ``valid_from`` and ``valid_to``.

    ``valid_to`` is the key's next batch, NULL for the current version. After one row per
    (key, batch) is left, rows are numbered in the order of key and batch and cut into pieces
    of ``piece`` rows, whatever their keys and batch numbers. A row's next one is in its piece,
    or heads the following piece; the heads are one row in ``piece``. Pass ``batches`` when the
    feed is known to have at most ``piece`` of them: a key's rows are one piece then, and need
    no numbering. ``unique`` skips the reduction for feeds that hold each (key, batch) once by
    construction; a feed that does not fails.
    """
    rows = feed if unique else _latest(feed, [*keys, batch], batch)
    opened = rows.withColumn("valid_from", F.col(batch))
    if batches is not None and batches <= piece:
        next_batch = F.lead(batch).over(Window.partitionBy(*keys).orderBy(batch))
        return opened.withColumn("valid_to", _following(next_batch, batch))
    number, slot, following = "__n", "__piece", "__next"
    numbered = dense_ids(opened, [*keys, batch], number, 0)
    size = F.lit(piece).cast("long")
    cut = numbered.withColumn(slot, F.call_function("div", F.col(number), size))
    names = [f"__k{i}" for i in range(len(keys))]
    heads = numbered.filter(F.col(number) % size == 0).select(
        (F.call_function("div", F.col(number), size) - 1).alias("__s"), *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(batch).alias(following),
    )
    order = Window.partitionBy(slot).orderBy(number)
    goes_on = F.lead(number).over(order).isNotNull()
    for key in keys:
        goes_on = goes_on & F.lead(key).over(order).eqNullSafe(F.col(key))
    inside = F.when(goes_on, F.lead(batch).over(order))
    at_end = F.col(number) % size == size - 1
    for key, name in zip(keys, names):
        at_end = at_end & F.col(key).eqNullSafe(F.col(name))
    stitched = cut.withColumn("valid_to", inside).join(broadcast_if_small(heads), F.col(slot) == F.col("__s"), "left")
    found = F.coalesce("valid_to", F.when(at_end, F.col(following)))
    return stitched.withColumn("valid_to", _following(found, batch)).drop(number, slot, "__s", following, *names)


def extend_versions(table: DataFrame, feed: DataFrame, keys: Sequence[str], batch: str = "batch", **how) -> DataFrame:
    """Versions of a table and of a feed whose batches all come after the table's.

    Only the table's current rows, one per key, can change: they end where the feed's first
    version of their key begins.
    """
    added = written(versions(feed, keys, batch, **how), "new-versions")
    names = [f"__k{i}" for i in range(len(keys))]
    firsts = written(
        added.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min("valid_from").alias("__next")), "first-versions"
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    current = table.filter(F.col("valid_to").isNull()).join(broadcast_if_small(firsts), same, "left")
    ended = current.withColumn("valid_to", F.col("__next")).drop(*names, "__next")
    return table.filter(F.col("valid_to").isNotNull()).unionByName(ended).unionByName(added)


def _following(following: Column, batch: str) -> Column:
    """The next batch; a repeated (key, batch) fails the job instead of giving an empty version."""
    repeated = F.raise_error(F.lit("a key occurs twice in one batch of a feed that was called unique"))
    return F.when(following.eqNullSafe(F.col(batch)), repeated).otherwise(following)


def classify(feed: DataFrame, keys: Sequence[str], batch: str = "batch", column: str = "op",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark each row ``I`` when its batch is the key's first, ``U`` otherwise.

    First batches are found per key with a map-side combine, written once, and joined back. A
    key with more than ``hot_rows`` rows would make one join task slow, so rows of such keys
    meet a broadcast list instead and are not shuffled at all. There are at most (all rows /
    ``hot_rows``) such keys, which bounds the list.
    """
    first, weight = "__first", "__rows"
    names = [f"__k{i}" for i in range(len(keys))]
    per_key = written(
        feed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
            F.min(batch).alias(first), F.count(F.lit(1)).alias(weight)
        ),
        "first-batches",
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    hot, cold = per_key.filter(F.col(weight) > hot_rows), per_key.filter(F.col(weight) <= hot_rows)
    if hot.isEmpty():
        placed = feed.join(per_key, same)
    else:
        hot = broadcast_if_small(hot)
        placed = feed.join(hot, same).unionByName(feed.join(hot, same, "left_anti").join(cold, same))
    marked = placed.withColumn(column, _operation(F.col(batch).eqNullSafe(F.col(first))))
    return marked.drop(*names, first, weight)


def _operation(is_first: Column) -> Column:
    return F.when(is_first, F.lit("I")).otherwise(F.lit("U"))

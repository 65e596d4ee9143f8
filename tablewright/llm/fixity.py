"""Fixity audit of WARC records by Merkle trees.

A replica is a table of records: file, offset, length and the hash of the record's bytes.
Leaves of the tree are records; above them are ordered offset ranges of a file, each
``2**GROWTH`` times as wide as below, then files, then ranges of files up to one root. Two
replicas are compared from the root down, and only children of differing nodes are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators.sizes import broadcast_if_small
from tablewright.operators.tables import dense_ids
from tablewright.session import written

RANGE = 16  # a lowest range is 2**RANGE bytes
GROWTH = 6  # each level has ranges 2**GROWTH times as wide
WHOLE = 40  # bits of the offset in a file: files are shorter than 2**WHOLE bytes


def record(url: str = "url", body: str = "html") -> Column:
    """Bytes of an uncompressed WARC/1.1 resource record; null url or body count as empty."""
    content = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def placed(records: DataFrame, order: str, per_file: int = 1_000) -> DataFrame:
    """``records`` (with length) in archive files of ``per_file`` records: file and offset.

    Records are numbered in ``order`` without a table-wide window; offsets are sums in a file.
    """
    numbered = dense_ids(written(records, "warc-records"), [order], "_number", 0)
    in_file = Window.partitionBy("file").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    filed = numbered.withColumn("file", F.floor(F.col("_number") / per_file))
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(in_file), F.lit(0)).cast("long")).drop("_number")


def tree(records: DataFrame, files: int) -> list[DataFrame]:
    """Levels of a replica's tree, leaves first: node, parent and hash.

    A leaf's node is file * 2**WHOLE + offset, and each parent drops the lowest bits, so a
    lost record changes only the ranges above it. Children are hashed in order with their
    node, hence with their offset; a range holds at most 2**GROWTH ranges, or the records
    that begin in 2**RANGE bytes. Records that share a place are hashed in hash order.
    ``files`` is one more than the greatest file number of both replicas.
    """
    shifts = [RANGE, *range(RANGE + GROWTH, WHOLE, GROWTH), WHOLE]
    while 1 << (shifts[-1] - WHOLE) < files:
        shifts.append(shifts[-1] + GROWTH)
    node = F.shiftleft(F.col("file").cast("long"), WHOLE) + F.col("offset")
    level = records.select(node.alias("node"), F.concat_ws(":", F.col("length").cast("string"), "hash").alias("hash"))
    levels, below = [], 0
    for shift in shifts:
        level = written(level.withColumn("parent", F.shiftright("node", shift - below)), "merkle")
        levels.append(level)
        joined = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda s: F.concat_ws("=", s["node"].cast("string"), s["hash"]))
        level = level.groupBy(F.col("parent").alias("node")).agg(F.sha2(F.array_join(joined, "\n"), 256).alias("hash"))
        below = shift
    levels.append(written(level.withColumn("parent", F.lit(0).cast("long")), "merkle"))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where replicas differ: file, offset, status, first_hash, second_hash.

    Both have file, offset, length and hash. ``status`` is ``changed`` for a record of other
    content or length at its place, ``missing`` for one that the second replica lacks, and
    ``extra`` for one that only the second has. Equal replicas, empty ones too, give no rows.
    A place that holds several records is compared by all of their hashes at once. Offsets
    below 0 or from 2**WHOLE on are refused, as they would be taken for places in other files.
    """
    top = [r.agg(F.max("file").alias("file"), F.min("offset").alias("least"), F.max("offset").alias("most")).first() for r in (first, second)]
    if any(t.most is not None and (t.least < 0 or t.most >= 1 << WHOLE) for t in top):
        raise ValueError(f"offsets must be from 0 to 2**{WHOLE} - 1")
    files = max([t.file for t in top if t.file is not None], default=0) + 1
    trees = [tree(r, files) for r in (first, second)]
    suspects = None
    for level, other in zip(*(t[::-1] for t in trees)):
        mine, theirs = (
            (x if suspects is None else x.join(broadcast_if_small(suspects), "parent", "left_semi"))
            .groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias(name))
            for x, name in ((level, "first_hash"), (other, "second_hash"))
        )
        differing = mine.join(theirs, "node", "full_outer").filter(~F.col("first_hash").eqNullSafe(F.col("second_hash")))
        differing = written(differing, "merkle-differing")
        suspects = differing.select(F.col("node").alias("parent"))
    status = F.when(F.col("second_hash").isNull(), "missing").when(F.col("first_hash").isNull(), "extra").otherwise("changed")
    bare = [F.regexp_replace(h, "[0-9]+:", "").alias(h) for h in ("first_hash", "second_hash")]
    return differing.select(
        F.shiftright("node", WHOLE).alias("file"), F.col("node").bitwiseAND((1 << WHOLE) - 1).alias("offset"), status.alias("status"), *bare
    )

"""Merkle manifest of a dataset: every row's leaf, the root of all, and a proof for each leaf.

Rows of a group are leaves in order; every ``FANOUT`` consecutive nodes become their parent's
hash, the last run may be shorter. Partitions are aligned blocks of ``FANOUT**LOCAL`` leaves and
hash the levels inside them on their own. For the levels above they exchange roots like a
butterfly: in round r a partition meets those whose numbers differ from its own in the r-th
digit to base ``FANOUT``. All of them hash the common parent, redundantly, so each partition
ends with its whole path to the group's root and nothing has to be sent down the tree again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.sizes import broadcast_if_small
from tablewright.operators.tables import dense_ids
from tablewright.session import written

FANOUT = 8
LOCAL = 3  # levels inside a partition, which holds FANOUT**LOCAL leaves
_CHUNK = 65_536  # rows of a group that find their group's size under one key
_STEP = "array<struct<before:string,after:string>>"


def leaf(cells: Sequence[Column]) -> Column:
    """Hash of a row: ``-`` for a null cell, else its UTF-8 byte count, a colon and its text."""
    texts = [c.cast("string") for c in cells]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded(first: Column, path: Column) -> Column:
    """The root that ``first`` leads to with the siblings of ``path``."""
    return F.aggregate(path, first, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _siblings(nodes: Column, at: Column, fanout: int) -> Column:
    """before and after: the hashes of the other nodes of the run that holds number ``at``."""
    place = at % fanout
    return F.struct(
        F.array_join(F.slice(nodes, at - place + 1, place), "").alias("before"),
        F.array_join(F.slice(nodes, at + 2, fanout - 1 - place), "").alias("after"),
    )


def exchanged(states: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``states`` (tree, n, p, root) with the root of the tree and ``path``, from the bottom up.

    The ``n`` partitions of a tree are numbered by ``p`` from 0. After round r a partition knows
    the node of ``fanout**(r+1)`` partitions it is in. Subtrees of one parent are matched by the
    lower digits of their partitions' numbers. The last subtree may have fewer partitions than
    its siblings: its partitions stand in, in turns, for the missing numbers. So no message
    group has more than ``fanout`` members, and rounds grow with the logarithm of ``n``.
    """
    states = written(states.withColumn("path", F.array().cast(_STEP)), "manifest-roots")
    most, step = states.agg(F.max("n")).first()[0] or 0, 1
    while step < most:
        wide = F.lit(step).cast("long")
        number, low = F.call_function("div", F.col("p"), wide), F.col("p") % wide
        members = F.least(wide, F.col("n") - number * wide)
        sent = states.filter(F.col("n") > step).select(
            "tree", "n", F.call_function("div", number, F.lit(fanout).cast("long")).alias("parent"), low.alias("own"),
            (number % fanout).alias("digit"), "root", "p", "path", F.explode(F.sequence(low, wide - 1, members)).alias("low"),
        )
        real = F.col("low") == F.col("own")
        card = F.struct("digit", "root", real.alias("real"), F.when(real, F.col("p")).alias("p"), F.when(real, F.col("path")).alias("path"))
        met = sent.groupBy("tree", "n", "parent", "low").agg(F.array_sort(F.collect_list(card)).alias("cards"))
        roots = F.transform("cards", lambda c: c["root"])
        after = met.select("tree", "n", F.sha2(F.array_join(roots, ""), 256).alias("above"), "cards", F.explode(F.filter("cards", lambda c: c["real"])).alias("me"))
        others = F.struct(*(
            F.array_join(F.transform(F.filter("cards", keep), lambda c: c["root"]), "").alias(name)
            for name, keep in (("before", lambda c: c["digit"] < F.col("me.digit")), ("after", lambda c: c["digit"] > F.col("me.digit")))
        ))
        grown = after.select("tree", "n", F.col("me.p").alias("p"), F.col("above").alias("root"), F.concat("me.path", F.array(others)).alias("path"))
        states = written(grown.unionByName(states.filter(F.col("n") <= step)), "manifest-round")
        step *= fanout
    return states


def proofs(rows: DataFrame, group: str, order: Sequence[str], leaf_column: str = "leaf", fanout: int = FANOUT, local: int = LOCAL) -> DataFrame:
    """``rows`` with subroot, root and ``path``: the siblings (before, after) from leaf to root.

    Leaves of a ``group`` (null is one, and comes first) stand in ``order``, nulls first, then by
    leaf, so repeated rows are neighbours. The groups' roots, in the order of the groups, are
    the leaves of the tree above. A lone node is its own root. An empty table gives no rows.
    Columns of ``rows`` may have any names but the three that are added. Nothing is gathered but
    a partition of ``fanout**local`` leaves: a group with a third of all rows is many partitions.
    """
    width = fanout**local
    clash = {"subroot", "root", "path"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    keys = [f"o{i}" for i in range(len(order))]
    bare = rows.select(
        F.col(f"`{group}`").alias("g"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)],
        F.col(f"`{leaf_column}`").alias("leaf"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
    )
    numbered = dense_ids(bare, ["g", *keys, "leaf"], "at", 0)
    groups = written(numbered.groupBy("g").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("size")), "manifest-groups")
    chunk = F.lit(_CHUNK).cast("long")
    covered = F.sequence(F.call_function("div", F.col("tree"), chunk), F.call_function("div", F.col("tree") + F.col("size") - 1, chunk))
    extents = written(groups.select(F.col("g").alias("same"), "tree", "size", F.explode(covered).alias("chunk")), "manifest-extents")
    placed = numbered.withColumn("piece", F.call_function("div", F.col("at"), chunk)).join(
        broadcast_if_small(extents), (F.col("piece") == F.col("chunk")) & F.col("g").eqNullSafe(F.col("same"))
    )
    place = F.col("at") - F.col("tree")
    leaves = F.array_sort(F.collect_list(F.struct(place.alias("place"), "leaf", "row")))
    blocks = placed.groupBy("tree", "size", F.call_function("div", place, F.lit(width).cast("long")).alias("p")).agg(leaves.alias("leaves"))
    blocks = blocks.withColumn("level0", F.transform("leaves", lambda x: x["leaf"]))
    for k in range(local):
        # A level that is one node for the whole group is its root already.
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("size") > fanout**k, _parents(F.col(f"level{k}"), fanout)).otherwise(F.col(f"level{k}")))
    blocks = written(blocks, "manifest-blocks")
    parts = F.call_function("div", F.col("size") + (width - 1), F.lit(width).cast("long"))
    states = exchanged(blocks.select("tree", parts.alias("n"), "p", F.get(f"level{local}", F.lit(0)).alias("root")), fanout)

    # The groups' roots exchange in the same way, one row a group.
    ranked = dense_ids(states.filter("p = 0").select("tree", "root"), ["tree"], "p", 0)
    count = groups.count()
    tops = exchanged(ranked.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), "p", "root"), fanout)
    tops = ranked.select(F.col("tree").alias("_tree"), "p").join(tops.select("p", F.col("root").alias("top"), F.col("path").alias("above")), "p")
    tops = written(tops.drop("p"), "manifest-tops")
    known = states.join(broadcast_if_small(tops), F.col("tree") == F.col("_tree")).select(
        "tree", "p", F.col("root").alias("subroot"), "top", F.concat("path", "above").alias("upper")
    )

    def lower(number: Column) -> Column:
        levels = [
            F.when(F.col("size") > fanout**k, F.array(_siblings(F.col(f"level{k}"), F.call_function("div", number, F.lit(fanout**k)), fanout)))
            .otherwise(F.array().cast(_STEP))
            for k in range(local)
        ]
        return F.concat(*levels)

    with_paths = F.transform("leaves", lambda x, i: F.struct(x["row"].alias("row"), F.concat(lower(i), F.col("upper")).alias("path")))
    out = blocks.join(known, ["tree", "p"]).select(F.explode(with_paths).alias("x"), "subroot", F.col("top").alias("root"))
    return out.select("x.row.*", "subroot", "root", F.col("x.path").alias("path"))

"""From a feed to a stored table: batches applied as the object's type asks, and published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.feeds import FeedSpec, ObjectType
from tablewright.operators.tables import assign_ids, extend_versions, merge_snapshot, replace_snapshot, upsert, versions
from tablewright.sinks.state import State, current_state, publish, read_state
from tablewright.sources.objects import ObjectTable

VERSIONED = (ObjectType.STANDARD_BITEMPORAL, ObjectType.VERSIONED_BITEMPORAL, ObjectType.VERSIONED_TRANSACTIONAL)


def keys_of(spec: FeedSpec) -> list[str]:
    """The columns that identify a row of the table: its id, or the candidate key."""
    if spec.id_column:
        return [spec.id_column]
    return [k.strip() for k in spec.candidate_keys if k.strip()]


def apply_feed(feed: DataFrame, table: ObjectTable, spec: FeedSpec, order: Sequence[str] = (), batch: str = "batch",
               stream: tuple[str, int] | None = None) -> State | None:
    """Apply the batches of a feed to the published state of a table and publish the result.

    How a batch is applied follows from ``spec.object_type``; ``order`` numbers new rows of a
    standard object within their batch. A batch counts once: rows of batches up to the last
    applied one are left out, so a job that failed may be run again with the same feed. Within
    a ``stream``, a (name, epoch) pair counts once instead, and a batch may come in pieces. A
    feed without new rows leaves the state as it is.

    Keyed states are stored in key order. While batches come one after the other, rows of the
    state are not ranked again; snapshots and transactional rows do not read it at all.
    """
    spark, kind, keys = feed.sparkSession, spec.object_type, keys_of(spec)
    state = current_state(spark, table)
    streams = dict(state.streams) if state else {}
    last = state.last_batch if state else None
    if stream is not None:
        name, epoch = stream
        if streams.get(name, -1) >= epoch:
            return state
        streams[name] = epoch
    elif last is not None:
        feed = feed.filter(F.col(batch) > last)
    low, high = feed.agg(F.min(batch), F.max(batch)).first()
    if low is None:
        return state
    follows = last is not None and low > last
    done = {"last_batch": high if last is None else max(high, last), "streams": streams}
    if kind is ObjectType.STANDARD_TRANSACTIONAL:
        return publish(feed, table, state, add=True, **done)
    if kind is ObjectType.COMPLETE_SNAPSHOT:
        if last is not None and high < last:
            return state
        return publish(replace_snapshot(feed, batch), table, state, **done, add=last == high)
    held = read_state(spark, table, state) if state else None
    if kind is ObjectType.STANDARD:
        rows = assign_ids(held, feed, keys[0], list(order), batch, follows)
    elif kind in VERSIONED:
        if held is None:
            rows = versions(feed, keys, batch)
        elif follows:
            rows = extend_versions(held, feed, keys, batch)
        else:
            rows = versions(held.drop("valid_from", "valid_to").unionByName(feed), keys, batch)
    elif kind is ObjectType.INCREMENTAL_SNAPSHOT:
        rows = merge_snapshot(held, feed, keys, batch, follows)
    else:
        rows = upsert(held, feed, keys, batch, follows)
    return publish(rows, table, state, cluster_by=keys, **done)

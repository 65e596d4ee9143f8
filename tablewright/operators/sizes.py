"""Broadcasting only what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
_CELL = 16  # bytes per cell besides its content


def content_bytes(df: DataFrame) -> int:
    """Bytes of all cells as text, with an allowance per cell."""
    if not df.columns:
        return 0
    row = F.lit(_CELL * len(df.columns))
    for name in df.columns:
        row = row + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Ask for a broadcast when the content fits; beyond that the join is left to shuffle.

    ``df`` is measured by a scan, so it should be a written table or cheap to compute.
    """
    bound = BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(df) if content_bytes(df) <= bound else df

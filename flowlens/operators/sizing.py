"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.session import materialize

SMALL_ROWS = 10_000
SMALL_TABLE_ROWS = 200_000
SMALL_BYTES = 16 * 1024 * 1024


def pin_if_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Compute a side that is expected to be small once and mark it for broadcast.

    At most ``max_rows + 1`` rows are written to the shared folder, and rows and bytes are measured
    there: nothing comes to the driver before it is known to be small. A side over either bound
    comes back as it was, without a hint: the join then shuffles and adaptive execution splits its
    hot keys. Needed for aggregated sides, whose size Catalyst cannot estimate and whose few keys
    (five payment formats, say) would make the shuffle a skewed one.
    """
    head = materialize(df.limit(max_rows + 1))
    return F.broadcast(head) if _is_small(head, max_rows, max_bytes) else df


def broadcast_if_small(table: DataFrame, max_rows: int = SMALL_TABLE_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """The same for what is a table already."""
    return F.broadcast(table) if _is_small(table, max_rows, max_bytes) else table


def _is_small(table: DataFrame, max_rows: int, max_bytes: int) -> bool:
    text = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes

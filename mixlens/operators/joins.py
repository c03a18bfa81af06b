"""Join helpers: broadcast only behind a checked row count.

``bounded_broadcast`` materialises the small side once (a reliable checkpoint
in the cluster's checkpoint folder, so it survives executor loss and cuts a
long lineage), counts it, and marks it for broadcast only when the count is
under the bound.  Above the bound the side is returned as is and the join
plans as a shuffle (sort-merge) join; nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlens.session import cut_lineage

# one row per calendar day: 200k rows is more than 500 years of a daily series
MAX_BROADCAST_ROWS = 200_000


def bounded_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      materialise: bool = True) -> DataFrame:
    snap = cut_lineage(small) if materialise else small
    n = snap.count()
    return F.broadcast(snap) if n <= max_rows else snap

"""Join strategy helpers.

Broadcasting is only ever requested for a side whose counted rows are
checked against a bound; otherwise the plan is left to Catalyst, and AQE
re-plans at run time from the measured shuffle sizes (it turns a sort-merge
join into a broadcast join when a side turns out small, and splits skewed
partitions when one key is hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest estimated size hinted for broadcast (bytes).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES, row_bytes: int = 128) -> DataFrame:
    """Hint a broadcast only when the counted rows times a row's width are under
    the bound.  The count reads the frame: pass one that is materialised or
    cheap to read."""
    rows = max_bytes // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

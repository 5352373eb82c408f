"""Column-expression helpers (pure ``Column -> Column``; no data access)."""

from loadcast.functions.clock import (  # noqa: F401
    SLOT_MINUTES,
    SLOTS_PER_DAY,
    SLOTS_PER_HOUR,
    SLOTS_PER_WEEK,
    clock_parts,
    floor_15min,
    floor_hour,
    is_weekend,
    ntz,
    shift,
    slot_index,
    slot_start,
    to_local,
)
from loadcast.functions.exprs import (  # noqa: F401
    MILLI,
    clip,
    from_milli,
    mean_from_milli,
    null_safe_mean,
    row_sum_null_as_zero,
    to_milli,
)

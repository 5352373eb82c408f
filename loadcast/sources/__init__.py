"""Sources: stored tables, the consumption fact and the lookups."""

from loadcast.sources.consumption import (  # noqa: F401
    attach_community,
    community_map,
    consumption,
    raw_readings,
    readings_from_consumption,
    readings_from_events,
    restrict_time,
    to_cells,
)
from loadcast.sources.lookups import (  # noqa: F401
    calendar_holidays,
    daily_visitors,
    holiday_flags,
    hourly_forecasts,
    project_daily,
    project_hourly,
    weekday_dates,
)
from loadcast.sources.tables import TABLE_NAMES, Catalog, read_source, read_table  # noqa: F401

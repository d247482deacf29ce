"""Time-zone tables derived from the installed IANA database: zone names and the abbreviations each zone uses."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

#: Years whose abbreviations count. Abbreviations of older rules (war time, local mean time) are not in use any more.
FIRST_YEAR, LAST_YEAR = 1990, 2037


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    """All IANA zone names of the installed database, sorted."""
    return tuple(sorted(z for z in available_timezones() if "/" in z or z in ("UTC", "GMT")))


@lru_cache(maxsize=1)
def zone_abbreviations() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) for every letter abbreviation that a zone uses.

    An abbreviation whose offset changed in a zone keeps the latest one. The size is bounded by the IANA database:
    about 600 zones of a few abbreviations each.
    """
    rows = []
    for name in zone_names():
        zone, found = ZoneInfo(name), {}
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(zone)
                if re.fullmatch("[A-Za-z]{2,5}", at.tzname() or ""):
                    found[at.tzname().upper()] = int((at.utcoffset() or timedelta()).total_seconds())
        rows += [(name, abbreviation, offset) for abbreviation, offset in sorted(found.items())]
    return tuple(rows)

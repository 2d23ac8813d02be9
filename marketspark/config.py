"""Parameters of a market report; nothing here is read from the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class MarketConfig:
    """``as_of`` plays the part of "today" in every computation, so a report can be repeated."""

    as_of: date
    horizons: tuple[int, ...] = (60, 120, 180, 270, 360)
    trend_horizons: tuple[int, ...] = (60, 180, 360)
    sale_count_days: tuple[int, ...] = (1, 91, 182, 365)
    rolling_rows: int = 19
    category_order: tuple[str, ...] = ("residential", "patio home", "townhome")
    status_order: tuple[str, ...] = ("Sold", "Under Contract", "For Sale")
    # A street label keeps its plain name for these, whatever the category.
    unsuffixed_areas: tuple[str, ...] = ()

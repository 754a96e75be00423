"""Scalar helpers: calendar arithmetic and output shaping."""

from .calendar import (day_spine, day_window, days_in_month, in_window, month_parts, month_window, today_parts,
                       year_window)
from .shape import entries_json, pad2, to_nested_json

__all__ = ["day_spine", "day_window", "days_in_month", "in_window", "month_parts", "month_window",
           "today_parts", "year_window", "entries_json", "pad2", "to_nested_json"]

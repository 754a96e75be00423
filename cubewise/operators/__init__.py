"""Query operators over cubes: each takes and returns a DataFrame."""

from .fill import empty_fill_days, zero_fill_days
from .history import all_time_top_items, item_totals, period_values, top_items
from .latest import latest_items
from .live import day_leader, day_mean, day_total, in_month, month_by_day, month_top_items, on_day
from .topn import leader, top_n

__all__ = ["empty_fill_days", "zero_fill_days", "all_time_top_items", "item_totals", "period_values",
           "top_items", "latest_items", "day_leader", "day_mean", "day_total", "in_month", "month_by_day",
           "month_top_items", "on_day", "leader", "top_n"]

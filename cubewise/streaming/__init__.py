"""Structured Streaming feed jobs for the live cubes and latest lists."""

from .changes import latest_changes, read_changing_lists, start_changing_lists
from .hourly import hourly_updates, live_updates, read_event_stream, start_hourly_cube, upsert_hours
from .late import correct_hours, start_late_posts
from .latest import read_latest_lists, start_latest_lists

__all__ = ["correct_hours", "hourly_updates", "latest_changes", "live_updates", "read_changing_lists", "read_event_stream", "read_latest_lists",
           "start_changing_lists", "start_hourly_cube", "start_late_posts", "start_latest_lists", "upsert_hours"]

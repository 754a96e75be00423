"""cubewise: activity cubes and their queries, on Spark DataFrames.

Batch (and streaming) jobs build aggregate cubes from raw posts; route
functions answer parameterised questions over them (values per period,
ranked and unranked top-N items, day totals and means, calendar-filled daily
series, leading items, newest-first lists). Everything is a lazy DataFrame.
"""

from .catalog import FAMILIES, family
from .plans.bindings import StoredCubes, TableCubes, build_all
from .plans.routes import answer
from .session import build_session, checkpoint_dir

__all__ = ["FAMILIES", "family", "StoredCubes", "TableCubes", "build_all", "answer",
           "build_session", "checkpoint_dir"]

"""Historic routes: values per period and top-N items per period.

Inputs are flat cubes: ``party, year[, month | week][, <item>], <measure>``.
Filters are written before any aggregate; on a stored cube partitioned by
``year`` the year predicate prunes partitions, on a cube derived from raw
rows Catalyst moves it below the cube's aggregate.

Results are long frames. Periods and ranks are ``bigint``, measures
``double``. One-party results drop the party column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import stable_round
from .topn import pruned_top_n, top_n

GRAINS = ("year", "month", "week")


def _check_grain(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def _restrict(cube: DataFrame, year: int | None, party: str | None) -> DataFrame:
    conds = ([F.col("year") == F.lit(year)] if year is not None else []) + \
            ([F.col("party") == F.lit(party)] if party is not None else [])
    if not conds:
        return cube
    cond = conds[0] if len(conds) == 1 else conds[0] & conds[1]
    return cube.where(cond)


def period_values(cube: DataFrame, grain: str = "year", year: int | None = None, party: str | None = None,
                  measure: str = "count", digits: int | None = None) -> DataFrame:
    """Value per (party, period), read straight from a count cube as stored
    (rounded to ``digits`` places if given, see ``functions.numbers.stable_round``).

    The cube holds one row per key; no aggregation happens here (a duplicate
    key is a cube defect, see ``sources.cubes.duplicate_keys``).
    """
    _check_grain(grain)
    value = F.col(measure).cast("double")
    if digits is not None:
        value = stable_round(value, digits)
    cols = [] if party is not None else [F.col("party")]
    cols += [F.col(grain).cast("long").alias(grain), value.alias("value")]
    return _restrict(cube, year, party).select(*cols)


def item_totals(cube: DataFrame, item: str, keys: list[str], measure: str = "count") -> DataFrame:
    """Sum of the measure by ``keys`` and item (partial + final hash aggregate)."""
    return cube.groupBy(*keys, item).agg(F.sum(F.col(measure).cast("double")).alias("total"))


def top_items(cube: DataFrame, item: str, grain: str, n: int, year: int | None = None, party: str | None = None,
              ranked: bool = True, measure: str = "count") -> DataFrame:
    """Top ``n`` items by summed measure within each (party, period).

    Columns: ``[party,] <grain>, [rank,] <item>, total``.
    """
    _check_grain(grain)
    # Group by the cube's whole period key (year and month/week), as the cube
    # itself is grouped: the sum then reuses the cube aggregate's hash
    # partitioning instead of shuffling again, and months of different years
    # never merge when no year is given.
    keys = ["party", "year"] if grain == "year" else ["party", "year", grain]
    totals = item_totals(_restrict(cube, year, party), item, keys, measure)
    best = top_n(totals, keys, "total", item, n)
    cols = [] if party is not None else [F.col("party")]
    if grain != "year" and year is None:
        cols.append(F.col("year").cast("long").alias("year"))
    cols.append(F.col(grain).cast("long").alias(grain))
    if ranked:
        cols.append(F.col("rank").cast("long").alias("rank"))
    cols += [F.col(item), F.col("total")]
    return best.select(*cols)


def all_time_top_items(cube: DataFrame, item: str, n: int, party: str | None = None,
                       measure: str = "count", pruned: bool = False) -> DataFrame:
    """Top ``n`` items per party summed over all periods (the legislative-term view).

    With ``pruned``, for stored yearly cubes of very many items, items that
    cannot be among the first are left out before the shuffle (see
    ``topn.pruned_top_n``); the answer is the same.

    Columns: ``party, <item>, total``.
    """
    if pruned:
        return pruned_top_n(_restrict(cube, None, party), ["party"], ["year"], item, n, measure).select("party", item, "total")
    totals = item_totals(_restrict(cube, None, party), item, ["party"], measure)
    return top_n(totals, ["party"], "total", item, n).select("party", item, "total")

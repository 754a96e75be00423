"""Per-group top-N and per-group leader.

Ranks are row numbers (ties get different ranks), ordered by descending total
and then by item ascending, so every result is deterministic.

Plan shape: ``row_number() <= N`` over a partitioned window lets Catalyst
insert a partial ``WindowGroupLimit`` before the window's shuffle, so each
map task ships at most N rows per group. A group holding a third of all rows
therefore costs one sorted pass per map task, not one task holding the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Candidates that are broadcast to a second pass; more of them are shuffled.
FEW = 500_000


def top_n(df: DataFrame, group_cols: list[str], total: str, item: str, n: int, rank_col: str = "rank") -> DataFrame:
    """Keep the top ``n`` rows of each group, numbered 1..k in ``rank_col``."""
    if n < 1:
        raise ValueError("n must be positive")
    order = [F.col(total).desc(), F.col(item).asc()]
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def leader(df: DataFrame, group_cols: list[str], item: str, total: str) -> DataFrame:
    """The item with the largest total in each group (smallest item on ties).

    An aggregate, not a window: ``min_by`` over ``(-total, item)`` runs as a
    partial aggregate before the shuffle, so a hot group is pre-reduced.
    """
    key: Column = F.struct((-F.col(total)).alias("neg_total"), F.col(item).alias("item"))
    return df.groupBy(*group_cols).agg(F.min_by(F.col(item), key).alias(item))


def pruned_top_n(rows: DataFrame, group_cols: list[str], parts: list[str], item: str, n: int, measure: str = "count",
                 few: int = FEW) -> DataFrame:
    """The top ``n`` items of each group by summed ``measure``, without summing
    all items: ``group_cols, item, total, rank``, as :func:`top_n` of the full sums.

    ``rows`` hold at most one row per (group, part, item), as a stored cube
    does with its periods as parts, and no negative measure. Then

    1. the top ``n`` rows of each part (a partial group limit, so few rows are
       shuffled) give, summed by item, a bound: the ``n``-th of these sums is
       at most the ``n``-th total;
    2. an item that reaches the bound over P parts has a row of at least the
       bound divided by P: items with such a row are the candidates, all others
       cannot be in the answer;
    3. rows of candidates are summed exactly, and the top ``n`` taken.

    Only candidates' rows are shuffled then, where there are up to ``few`` of
    them (counted, and broadcast). The bound and the candidates are written to
    the shared checkpoint folder when this is called: two short jobs. A group
    with fewer than ``n`` items has no bound and is summed as it is. A negative
    measure raises an error when the answer is read.
    """
    value = F.col(measure).cast("double")
    checked = F.when(value >= 0, value).otherwise(F.raise_error(F.lit("a negative measure cannot be pruned")).cast("double"))
    rows = rows.select(*group_cols, *parts, item, F.when(value.isNull(), value).otherwise(checked).alias("_value")).where("_value is not null")
    partial = top_n(rows, [*group_cols, *parts], "_value", item, n).groupBy(*group_cols, item).agg(F.sum("_value").alias("_value"))
    nth = top_n(partial, group_cols, "_value", item, n).groupBy(*group_cols).agg(
        F.when(F.count("*") >= n, F.min("_value")).otherwise(0.0).alias("_nth"))
    sizes = rows.select(*group_cols, *parts).distinct().groupBy(*group_cols).agg(F.count("*").alias("_parts"))
    checkpoint_dir(rows.sparkSession)
    # sums of doubles depend on their order: the bound is taken a little lower
    bound = nth.join(sizes, group_cols).select(*group_cols, (F.col("_nth") / F.col("_parts") * (1 - 1e-9)).alias("_least")).checkpoint()
    bound = F.broadcast(bound) if bound.limit(few + 1).count() <= few else bound
    candidates = rows.join(bound, group_cols).where("_value >= _least").select(*group_cols, item).distinct().checkpoint()
    candidates = F.broadcast(candidates) if candidates.limit(few + 1).count() <= few else candidates
    totals = rows.join(candidates, [*group_cols, item], "left_semi").groupBy(*group_cols, item).agg(F.sum("_value").alias("total"))
    return top_n(totals, group_cols, "total", item, n)

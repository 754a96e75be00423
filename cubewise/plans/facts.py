"""Order and line facts: lines stored by the month of their order.

Raw lines carry no date, so a route over one year's lines has to join all of
lineitem with that year's orders. The facts hold the join's result once:

- ``orders``: one row per order with its party, time and line statistics;
- ``lines``: one row per line with its order's party and time and its part's
  brand and name.

Both are partitioned by the order's (year, month) and published as versions
(:mod:`cubewise.sources.versions`). A one-year route is then a partition
filter: no line of another year is read, and nothing is shuffled on the order
or part key. :class:`FactCubes` answers all routes from them.

:meth:`Facts.apply` takes changed rows. Their orders, before and after, tell
the months to rewrite and the days whose cubes change; lines of other months
are not read. Lines whose order is not known yet wait in a partition of their
own (year 0) until it comes.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import Window, each_window, in_window
from ..sources.versions import Scope, Versions
from .bindings import TableCubes
from .cubes import CALENDAR

MONTH = ("year", "month")
#: Partition of lines without an order.
WAITING = ("0", "0")
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus"]


@dataclass(frozen=True)
class Changes:
    """Rows that changed in the raw tables. ``orders`` and ``lines`` have the
    columns of ``orders`` and ``lineitem``: new rows, or new values of known
    keys. ``deleted_orders`` has ``o_orderkey`` (its lines stay, without an
    order, unless they are deleted too), ``deleted_lines`` has ``l_orderkey,
    l_linenumber``, ``parts`` the ``p_partkey`` of parts whose attributes changed."""

    orders: DataFrame | None = None
    lines: DataFrame | None = None
    deleted_orders: DataFrame | None = None
    deleted_lines: DataFrame | None = None
    parts: DataFrame | None = None


def _month_keys(ts: Column) -> list[Column]:
    return [F.coalesce(F.year(ts), F.lit(0)).cast("long").alias("year"), F.coalesce(F.month(ts), F.lit(0)).cast("long").alias("month")]


def _as_posts(orders: DataFrame) -> DataFrame:
    return orders.select(*ORDER, F.col("o_orderpriority").alias("party"), F.col("o_orderdate").alias("ts"))


def _with_parts(lines: DataFrame, part: DataFrame, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """Lines with their part's brand and name, between other columns that stay."""
    part = part.select("p_partkey", "p_brand", "p_name")
    return lines.select(*before, *LINE, *after).join(part, F.col("l_partkey") == F.col("p_partkey"), "left") \
        .select(*before, *LINE, F.col("p_partkey").isNotNull().alias("has_part"), "p_brand", "p_name", *after)


def _placed(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with their order's party and time (null without one)."""
    return lines.join(orders.select("o_orderkey", "party", "ts"), F.col("l_orderkey") == F.col("o_orderkey"), "left") \
        .select("party", "ts", *[c for c in lines.columns if c not in ("party", "ts", *MONTH)], *_month_keys(F.col("ts")))


def _statistics(lines: DataFrame) -> DataFrame:
    """Per order: what its lines come to."""
    return lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_discount") * 100).alias("sum_disc100"),
        F.sum(F.length("p_name")).alias("sum_name_len"), F.sum(F.col("has_part").cast("long")).alias("n_parted"))


def _order_rows(orders: DataFrame, lines: DataFrame) -> DataFrame:
    joined = orders.join(_statistics(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_parted")]
    return joined.select("party", "ts", *ORDER, *counts, "sum_qty", "sum_disc100", "sum_name_len", *_month_keys(F.col("ts")))


def _months(window: Window | tuple[Window, ...]) -> Column:
    """Partition predicate of half-open time windows."""
    found = F.lit(False) if not window else None
    for start, end in each_window(window) if window else ():
        last = end - dt.timedelta(microseconds=1)
        number = F.col("year") * 12 + F.col("month")
        inside = F.col("year").between(F.lit(start.year), F.lit(last.year)) & \
            number.between(F.lit(start.year * 12 + start.month), F.lit(last.year * 12 + last.month))
        found = inside if found is None else found | inside
    return found


class Facts:
    """Order and line facts under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.versions = Versions(spark, root)

    def build(self, src: TableCubes) -> int:
        """Write both facts from the raw tables: lines meet orders and parts
        once, here. They meet their orders first, as bare keys and numbers: the
        texts of parts do not take part in that shuffle and its sort. Returns
        the version."""
        draft = self.versions.draft()
        orders = _as_posts(src.table("orders"))
        placed = _placed(src.table("lineitem").select(*LINE), orders)
        draft.write(_with_parts(placed, src.table("part"), ("party", "ts"), MONTH), "lines", MONTH)
        draft.write(_order_rows(orders, draft.frame("lines")), "orders", MONTH)
        return draft.publish()

    def apply(self, changes: Changes, src: TableCubes) -> list[dt.date]:
        """Publish a version with ``changes``; the days whose orders or lines
        changed, ascending. ``src`` gives the attributes of parts.

        Read are the changed rows, ``o_orderkey, party, ts`` of all orders
        (where the changed orders were before), and the months that these
        were in or are in now. The list of days is bounded by the calendar."""
        if all(getattr(changes, f.name) is None for f in fields(Changes)):
            return []
        draft = self.versions.draft()
        old_orders = draft.frame("orders")
        named = [(changes.orders, "o_orderkey"), (changes.deleted_orders, "o_orderkey"), (changes.lines, "l_orderkey"), (changes.deleted_lines, "l_orderkey")]
        keys = [df.select(F.col(c).alias("key")) for df, c in named if df is not None]
        if changes.parts is not None:  # the one change that can be anywhere: two columns of all lines
            lines = draft.frame("lines").select("l_orderkey", "l_partkey")
            keys.append(lines.join(changes.parts, lines["l_partkey"] == changes.parts["p_partkey"], "left_semi").select(F.col("l_orderkey").alias("key")))
        changed = keys[0]
        for k in keys[1:]:
            changed = changed.unionByName(k)
        changed = changed.where("key is not null").distinct()
        changed = self._kept(changed)

        def of(df: DataFrame, column: str, how: str) -> DataFrame:
            return df.join(changed, F.col(column) == F.col("key"), how)

        before = self._kept(of(old_orders.select(*ORDER, "party", "ts"), "o_orderkey", "left_semi"))
        after = before
        if changes.orders is not None:
            new = _as_posts(changes.orders)
            after = before.join(new.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(new)
        if changes.deleted_orders is not None:
            after = after.join(changes.deleted_orders.select("o_orderkey"), "o_orderkey", "left_anti")
        after = self._kept(after)

        times = before.select("ts").unionByName(after.select("ts"))
        days = sorted(r[0] for r in times.where("ts is not null").select(F.to_date("ts")).distinct().collect())
        touched = {(str(d.year), str(d.month)) for d in days} | {WAITING}
        scope: Scope = lambda k: (k["year"], k["month"]) in touched

        stored = draft.frame("lines", scope)
        raw = [*LINE, "has_part", "p_brand", "p_name"]
        lines = of(stored.select(*raw), "l_orderkey", "left_semi")
        at = ["l_orderkey", "l_linenumber"]
        if changes.deleted_lines is not None:
            lines = lines.join(changes.deleted_lines.select(*at), at, "left_anti")
        if changes.lines is not None:
            lines = lines.join(changes.lines.select(*at), at, "left_anti").unionByName(_with_parts(changes.lines, src.table("part")))
        if changes.parts is not None:
            lines = _with_parts(lines, src.table("part"))
        lines = self._kept(_placed(lines, after))
        rest = of(stored, "l_orderkey", "left_anti")
        draft.write(rest.unionByName(lines.select(rest.columns)), "lines", MONTH, scope)
        others = of(draft.frame("orders", scope), "o_orderkey", "left_anti")
        draft.write(others.unionByName(_order_rows(after, lines).select(others.columns)), "orders", MONTH, scope)
        draft.publish()
        return days

    def _kept(self, df: DataFrame) -> DataFrame:
        """Changed rows are read several times: written once, in the shared folder."""
        from ..session import checkpoint_dir

        checkpoint_dir(self.spark)
        return df.checkpoint()


class FactCubes(TableCubes):
    """Cube collections from the facts under ``root``; events and parts from the raw tables under ``base``.

    Reads the version that is newest when the instance is made, or after
    :meth:`refresh`: one consistent state for all cubes.
    """

    joined = True

    def __init__(self, spark: SparkSession, base: str, root: str, weeks: str = CALENDAR):
        super().__init__(spark, base, weeks)
        self.versions = Versions(spark, root)
        self._facts = self._newest()

    def _newest(self):
        manifest = self.versions.newest()
        if manifest is None:
            raise FileNotFoundError(f"no facts are published under {self.versions.root}")
        return manifest

    def refresh(self) -> None:
        super().refresh()
        self._facts = self._newest()

    def fact(self, name: str, window: Window | None = None) -> DataFrame:
        key = f"fact {name}"
        if key not in self._tables:
            self._tables[key] = self.versions.frame(self._facts, name)
        rows = self._tables[key]
        # lines without an order are in no window
        return rows.where(F.col("year") > 0) if window is None else rows.where(_months(window) & in_window("ts", window))

    def spans(self, most: int) -> list[Window]:
        """Windows of whole years that hold all lines, each of years that come
        to up to ``most`` bytes together; none where a year has no window."""
        years = [sorted(int(y) for y in some if int(y) > 0) for some in self.versions.portions(self._facts, "lines", "year", most)]
        years = [some for some in years if some]
        if any(some[-1] > 9998 for some in years):
            return []
        return [(dt.datetime(some[0], 1, 1), dt.datetime(some[-1] + 1, 1, 1)) for some in years]

    def orders(self, window: Window | None = None, *extra: str) -> DataFrame:
        return self.fact("orders", window).select("o_orderkey", "party", "ts", *extra)

    def lines(self, window: Window | None = None, part_col: str | None = None) -> DataFrame:
        rows = self.fact("lines", window)
        return rows.where("has_part").select("party", "ts", "l_suppkey", part_col) if part_col else rows.select("party", "ts", "l_suppkey")

    def order_stats(self, window: Window | None = None, name_length: bool = False, keep_lineless: bool = False,
                    extra: tuple[str, ...] = ()) -> DataFrame:
        rows = self.fact("orders", window)
        n = F.col("n_parted" if name_length else "n_lines")
        if not keep_lineless:
            rows = rows.where(n > 0)
        return rows.select("o_orderkey", "party", "ts", *extra, n.alias("n_lines"), "sum_qty", "sum_disc100", "sum_name_len")

    def line_rows(self, window: Window | None = None) -> DataFrame:
        return self.fact("lines", window).select(
            "party", "ts", "has_part", F.col("p_brand").alias("hashtag"), F.col("p_name").alias("url"), "l_suppkey", "l_quantity", "l_discount")

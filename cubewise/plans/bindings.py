"""Where the cubes come from.

:class:`TableCubes` derives every cube collection from the raw driver tables
(the stand-ins for raw posts), lazily, as one plan with the route's query on
top. :class:`StoredCubes` reads collections written by :func:`build_all`.
Both expose ``cube(collection, grain=None, window=None)`` returning a flat
frame, so routes are answered the same way from either.

Binding of the families to the driver tables (our definitions, since the
original feed jobs are not available): historic posts are orders, with the
order priority as the party and the order date as the time; lines are
lineitem rows of those orders; live posts are events, with the event type as
the party.

``window`` is a half-open time range the route needs (its year, day or
month). It is applied as a plain comparison on the raw time column, which
Parquet turns into row-group skipping (``PushedFilters``), before any join
or aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calendar import Window, in_window
from ..catalog import COUNT, FAMILIES
from ..sources.cubes import assert_unique, flatten_id, known_keys
from ..sources.tables import read_table
from ..sources.versions import Collection, Manifest, Versions
from . import cubes as B

GRAINS = ("year", "month", "week")
VALUE_CUBES = {f.cube for f in FAMILIES if f.group == COUNT}
MAX_CUBE_PLANS = 512


# Hourly live cubes: collection -> (measure name, item name or None).
LIVE_CUBES = {
    "metricsByHourAndParty": ("count", None),
    "mediaUsageRunningByHourAndParty": ("count", None),
    "sentimentRunningByHourAndParty": ("sentiment", None),
    "mostActiveRunningByHourAndParty": ("count", "username"),
    "sourceRunningByHourAndParty": ("count", "source"),
    "hashtagsByHourAndParty": ("count", "hashtag"),
}


def live_definition(collection: str) -> tuple[Column, str, Column | None, str | None]:
    """(aggregate, measure name, item expression, item name) of an hourly cube
    over event posts; shared by the batch builder and the streaming job."""
    name, item_name = LIVE_CUBES[collection]
    k = F.get_json_object(F.col("props"), "$.k")
    measure = {
        "mediaUsageRunningByHourAndParty": F.sum(F.when(F.col("value") > 50, 1).otherwise(0)),
        "sentimentRunningByHourAndParty": F.avg("value"),
    }.get(collection, F.count(F.lit(1)))
    item = {"username": F.col("user_id"), "source": k, "hashtag": k.cast("long") % 10}.get(item_name)
    return measure, name, item, item_name


def live_cube(events: DataFrame, collection: str) -> DataFrame:
    """Batch hourly cube ``collection`` from event posts."""
    measure, name, item, item_name = live_definition(collection)
    if item is None:
        return B.hourly_cube(events, measure, name)
    return B.hourly_item_cube(events, item, item_name)


class CubeSource(Protocol):
    """Anything that hands out cube collections as flat frames."""

    def cube(self, collection: str, grain: str | None = None, window: Window | None = None) -> DataFrame: ...


class TableCubes:
    """Cube collections computed from the raw tables under ``base``. With
    ``weeks="iso"`` the years of week cubes are ISO week-years."""

    #: Whether lines are stored with their order and part, so that reading some columns of them again is no join.
    joined = False

    def spans(self, most: int) -> list[Window]:
        """Windows to count lines in one after another; none: all at once."""
        return []

    def __init__(self, spark: SparkSession, base: str, weeks: str = B.CALENDAR):
        self.spark = spark
        self.base = base.rstrip("/")
        self.weeks = weeks
        B.week_grain(None, weeks)
        self._tables: dict[str, DataFrame] = {}
        self._cubes: dict[tuple, DataFrame] = {}
        self._historic: dict[str, Callable[[str, Window | None], DataFrame]] = {
            "countTotal": lambda g, w: B.measure_cube(self.orders(w), g, F.count(F.lit(1))),
            "avgReplies": lambda g, w: B.measure_cube(
                self.order_stats(w, keep_lineless=True), g, F.avg(F.coalesce(F.col("n_lines"), F.lit(0)))),
            "avgLikes": lambda g, w: B.measure_cube(
                self.order_stats(w), g, F.sum("sum_qty") / F.sum("n_lines")),
            "avgRetweets": lambda g, w: B.measure_cube(
                self.order_stats(w), g, F.sum("sum_disc100") / F.sum("n_lines")),
            "avgTweetLength": lambda g, w: B.measure_cube(
                self.order_stats(w, name_length=True), g, F.sum("sum_name_len") / F.sum("n_lines")),
            "mediaUsage": lambda g, w: B.measure_cube(
                self.orders(w, "o_orderstatus"), g,
                F.avg(F.when(F.col("o_orderstatus") == "F", F.lit(100.0)).otherwise(F.lit(0.0)))),
            "totalReplies": lambda g, w: B.measure_cube(
                self.order_stats(w, keep_lineless=True), g, F.sum(F.coalesce(F.col("n_lines"), F.lit(0)))),
            "hashtags": lambda g, w: B.item_cube(self.lines(w, "p_brand"), g, F.col("p_brand"), "hashtag"),
            "mostTweetsDay": lambda g, w: B.item_cube(
                self.orders(w), g, F.date_format("ts", "EEEE"), "weekday"),
            "mostTweetsTime": lambda g, w: B.item_cube(self.events(w), g, F.hour("ts"), "hour"),
            "mostActiveUsers": lambda g, w: B.item_cube(self.orders(w, "o_custkey"), g, F.col("o_custkey"), "user"),
            "mostTaggedUsers": lambda g, w: B.item_cube(self.lines(w), g, F.col("l_suppkey"), "taggedUser"),
            "urls": lambda g, w: B.item_cube(self.lines(w, "p_name"), g, F.col("p_name"), "url"),
        }
        self._live: dict[str, Callable[[Window | None], DataFrame]] = {
            name: (lambda w, _name=name: live_cube(self.events(w), _name)) for name in LIVE_CUBES}
        self._live["lastTweets"] = lambda w: B.latest_lists(self.events(w), "event_id")

    # -- raw posts -------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """Table ``name``. Its frame is made once per instance, so its file
        listing is done once, not per query."""
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.base, name)
        return self._tables[name]

    def read(self, name: str, cols: list[str]) -> DataFrame:
        """Columns ``cols`` of table ``name``."""
        return self.table(name).select(*cols)

    def refresh(self) -> None:
        """Forget table and cube handles (after the tables' files changed)."""
        self._tables.clear()
        self._cubes.clear()

    def orders(self, window: Window | None = None, *extra: str) -> DataFrame:
        """Orders as posts: ``o_orderkey, party, ts[, extra]``, restricted to ``window``."""
        o = self.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("party"),
                                        F.col("o_orderdate").alias("ts"), *extra)
        return o if window is None else o.where(in_window("ts", window))

    def lines(self, window: Window | None = None, part_col: str | None = None) -> DataFrame:
        """Lines of the orders in ``window``: ``party, ts, l_suppkey[, part_col]``."""
        li = self.read("lineitem", ["l_orderkey", "l_suppkey"] + (["l_partkey"] if part_col else []))
        rows = li.join(self.orders(window), li["l_orderkey"] == F.col("o_orderkey"))
        if part_col:
            part = self.read("part", ["p_partkey", part_col])
            rows = rows.join(part, rows["l_partkey"] == part["p_partkey"])
        return rows

    def order_stats(self, window: Window | None = None, name_length: bool = False,
                    keep_lineless: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
        """One row per order with its line statistics.

        Lines are reduced to one row per order before the join with orders
        (a partial + final aggregate on the order key), and the join then
        reuses that partitioning: lineitem crosses the network once, already
        combined. ``keep_lineless`` keeps orders without lines (left join,
        null statistics) for per-order measures.
        """
        li = self.read("lineitem", ["l_orderkey", "l_quantity", "l_discount"] + (["l_partkey"] if name_length else []))
        aggs = [F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
                F.sum(F.col("l_discount") * 100).alias("sum_disc100")]
        if name_length:
            part = self.read("part", ["p_partkey", "p_name"])
            li = li.join(part, li["l_partkey"] == part["p_partkey"])
            aggs.append(F.sum(F.length("p_name")).alias("sum_name_len"))
        per_order = li.groupBy("l_orderkey").agg(*aggs)
        how = "left" if keep_lineless else "inner"
        return self.orders(window, *extra).join(per_order, F.col("o_orderkey") == per_order["l_orderkey"], how)

    def order_times(self, window: Window | None = None) -> DataFrame:
        """``o_orderkey, party, ts`` of the orders that lines belong to."""
        return self.orders(window)

    def line_rows(self, window: Window | None = None) -> DataFrame:
        """Lines of the orders in ``window`` with all that cubes count: ``party,
        ts, has_part, hashtag, url, l_suppkey, l_quantity, l_discount``."""
        li = self.read("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount"])
        part = self.read("part", ["p_partkey", "p_brand", "p_name"])
        return (li.join(self.order_times(window), li["l_orderkey"] == F.col("o_orderkey"))
                .join(part, li["l_partkey"] == part["p_partkey"], "left")
                .select("party", "ts", F.col("p_partkey").isNotNull().alias("has_part"), F.col("p_brand").alias("hashtag"),
                        F.col("p_name").alias("url"), "l_suppkey", "l_quantity", "l_discount"))

    def events(self, window: Window | None = None) -> DataFrame:
        """Events as posts: ``party`` = event type, ``ts``, ids, value, props."""
        e = self.table("events").select("event_id", "ts", "user_id", F.col("event_type").alias("party"),
                                        "value", "props")
        return e if window is None else e.where(in_window("ts", window))

    # -- cubes -----------------------------------------------------------
    def cube(self, collection: str, grain: str | None = None, window: Window | None = None) -> DataFrame:
        """The cube as a lazy frame over the raw tables. The frame (a plan, no
        data) is made once per (collection, grain, window), so every route on
        the same cube reuses its analysed plan."""
        key = (collection, grain, window)
        if key not in self._cubes:
            if len(self._cubes) >= MAX_CUBE_PLANS:  # windows change over time: keep the newest plans
                self._cubes.pop(next(iter(self._cubes)))
            if collection in self._historic:
                if grain not in GRAINS:
                    raise ValueError(f"historic cube {collection!r} needs a grain in {GRAINS}")
                self._cubes[key] = self._historic[collection](B.week_grain(grain, self.weeks), window)
            elif collection in self._live:
                self._cubes[key] = self._live[collection](window)
            else:
                raise KeyError(f"unknown cube collection {collection!r}")
        return self._cubes[key]

    def collections(self) -> list[tuple[str, str | None]]:
        """Every (collection base, grain) pair the families read: 39 historic + 7 live."""
        return [(c, g) for c in self._historic for g in GRAINS] + [(c, None) for c in self._live]


class LateRows(TableCubes):
    """Rows that came late, as tables of their own under ``base``: orders,
    lineitem and events that the cubes do not hold yet, and parts. Late lines
    of orders that are known already get their party and time from ``known``,
    of which only ``days`` are read."""

    def __init__(self, spark: SparkSession, base: str, known: TableCubes | None = None, days: tuple[Window, ...] = (), weeks: str = B.CALENDAR):
        super().__init__(spark, base, weeks)
        self.known, self.days = known, days

    def order_times(self, window: Window | None = None) -> DataFrame:
        late = self.orders(window).select("o_orderkey", "party", "ts")
        if self.known is None or not self.days:
            return late
        before = self.known.orders(self.days).select("o_orderkey", "party", "ts")
        before = before if window is None else before.where(in_window("ts", window))
        return late.unionByName(before.join(late.select("o_orderkey"), "o_orderkey", "left_anti"))


#: Key columns of stored cubes whose nulls are checked (periods are partition columns).
ITEM_KEYS = {"party", "key"} | {f.item for f in FAMILIES if getattr(f, "item", None)}
#: A mean is stored as a sum and a number, which later rows can be added to.
SUM, NUMBER = "sum", "number"


class StoredCubes:
    """Cube collections read back from storage.

    By default the versions that :func:`build_all` published under ``root``:
    every call answers from the newest one, as a whole, and what is read of a
    version (its files, schemas, plans) is looked up once. :meth:`snapshot`
    stays with one version. Rows that were added to a partition are merged
    when read: counts are summed, and means, stored as a sum and a number, are
    divided after both are summed.

    Without published versions, a collection is the Parquet folder
    ``root/<collection name>``. Any other Spark source works too: ``fmt`` and
    ``options`` go to ``spark.read``; a connector that addresses a collection
    by an option instead of a path (a document store, say) gets the collection
    name in the option named ``collection_option``. Documents whose keys sit
    in an ``_id`` struct are flattened on read. With ``verify_keys``, a value
    cube (one value per party and period) is checked for duplicate keys when
    it is first opened, one aggregate per collection. Rows with a null key (a
    party or item that is missing) are an error when a route reads them; with
    ``on_null="drop"`` they are left out, with ``"keep"`` they are answered as
    null items.
    """

    def __init__(self, spark: SparkSession, root: str = "", fmt: str = "parquet",
                 options: dict[str, str] | None = None, collection_option: str | None = None,
                 verify_keys: bool = False, on_null: str = "error", version: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fmt = fmt
        self.options = dict(options or {})
        self.collection_option = collection_option
        self.verify_keys = verify_keys
        self.on_null = on_null
        self.version = version
        self.versions = Versions(spark, root) if fmt == "parquet" and root and not collection_option else None
        self._schemas: dict[tuple[str, str | None], StructType] = {}
        self._frames: dict[str, DataFrame] = {}
        self._frames_of: int | None = None

    @staticmethod
    def name(collection: str, grain: str | None = None) -> str:
        return collection if grain is None else f"{collection}By{grain.capitalize()}"

    def path(self, collection: str, grain: str | None = None) -> str:
        return f"{self.root}/{self.name(collection, grain)}"

    def snapshot(self) -> StoredCubes:
        """The same collections as the newest version has them now, whatever is published later."""
        manifest = self.versions and self.versions.newest()
        if manifest is None:
            raise FileNotFoundError(f"no version is published under {self.root}")
        return StoredCubes(self.spark, self.root, verify_keys=self.verify_keys, on_null=self.on_null, version=manifest.number)

    def _manifest(self) -> Manifest | None:
        if self.versions is None:
            return None
        return self.versions.newest() if self.version is None else self.versions.at(self.version)

    def cube(self, collection: str, grain: str | None = None, window: Window | None = None) -> DataFrame:
        """The collection as a flat frame, of the version that is newest at
        the call. Unversioned folders are listed anew on every call, so that a
        route asked after a rebuild reads the new files; only the schema is
        kept from the first use. The route's own key predicates (year / month /
        day) become partition filters on the stored layout; the raw-time
        ``window`` has no column here and is not needed."""
        name, manifest = self.name(collection, grain), self._manifest()
        if manifest is not None and name in manifest.collections:
            if self._frames_of != manifest.number:
                self._frames, self._frames_of = {}, manifest.number
            if name not in self._frames:
                self._frames[name] = self._opened(merged(self.versions.frame(manifest, name), manifest.collections[name]), collection, grain, True)
            return self._frames[name]
        key = (collection, grain)
        reader = self.spark.read.format(self.fmt).options(**self.options)
        if key in self._schemas:
            reader = reader.schema(self._schemas[key])
        if self.collection_option:
            df = reader.option(self.collection_option, name).load()
        else:
            df = reader.load(self.path(collection, grain))
        first, self._schemas[key] = key not in self._schemas, df.schema
        return self._opened(flatten_id(df), collection, grain, first)

    def by_day(self, collection: str) -> DataFrame | None:
        """The day rollup of an hourly collection, of the same version as the
        hours; None where there is none, or it was not kept up with them."""
        name, manifest = day_rollup(collection), self._manifest()
        if manifest is None or name not in manifest.collections or collection not in manifest.collections:
            return None
        if self._days_of(manifest, name) != self._days_of(manifest, collection):
            return None
        if self._frames_of != manifest.number:
            self._frames, self._frames_of = {}, manifest.number
        if name not in self._frames:
            self._frames[name] = self._opened(merged(self.versions.frame(manifest, name), manifest.collections[name]), collection, None, False)
        return self._frames[name]

    @staticmethod
    def _days_of(manifest: Manifest, name: str) -> set[tuple[str, str]]:
        """Partitions of a collection and the number of the version that wrote each."""
        return {(f.rpartition("/")[0], f.rpartition("=")[2].partition("-")[0]) for f in manifest.collections[name].folders}

    def _opened(self, df: DataFrame, collection: str, grain: str | None, first: bool) -> DataFrame:
        df = known_keys(df, [c for c in df.columns if c in ITEM_KEYS], self.on_null)
        if first and self.verify_keys and collection in VALUE_CUBES:
            # value routes read one value per key and never sum: check a
            # cube from elsewhere once, when it is first opened
            assert_unique(df, ["party", "year"] + ([grain] if grain != "year" else []))
        return df

    def refresh(self) -> None:
        """Forget schemas and plans (after cubes were rewritten with other columns)."""
        self._schemas.clear()
        self._frames.clear()


def day_rollup(collection: str) -> str:
    """Name of the day rollup of an hourly collection."""
    return f"{collection}ByDay"


def merged(rows: DataFrame, held: Collection) -> DataFrame:
    """Stored rows as a cube: one row per key, with its measure. Only a
    collection that was added to needs an aggregate."""
    measure = held.meta.get("measure")
    if measure is None:
        return rows
    parts = [SUM, NUMBER] if held.meta.get("mean") else [measure]
    keys = [c for c in rows.columns if c not in parts]
    if held.added_to:
        rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in parts))
    if not held.meta.get("mean"):
        return rows
    return rows.where(F.col(NUMBER) > 0).select(*keys, (F.col(SUM) / F.col(NUMBER)).alias(measure))


def build_all(source: TableCubes, root: str, parallel: int = 4, since=None, days=None, event_days=None) -> list[str]:
    """Write every cube collection under ``root`` (see :mod:`cubewise.plans.build`)."""
    from .build import build_all as _build

    return _build(source, root, parallel, since, days, event_days)


__all__ = ["CubeSource", "TableCubes", "LateRows", "StoredCubes", "build_all", "live_cube", "live_definition", "LIVE_CUBES"]

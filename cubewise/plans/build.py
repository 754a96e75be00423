"""The batch feed job: every cube collection from one pass per raw source.

Deriving each of the 46 collections from raw rows on its own would join and
scan lineitem-sized data dozens of times. Instead the job reads each raw
source once, into a *base* at the finest grain any collection needs (a
calendar day, or an hour for live cubes). Each base is a single aggregate
over ``GROUPING SETS``, so one scan and one shuffle of partial aggregates
serve several cubes. Only additive measures (sums and counts) are kept. The
bases are written to the shared folder, which also cuts lineage: a lost
executor re-reads a base instead of re-running the joins. Every collection is
then rolled up from them. Means are stored as a sum and a number.

Bases (grouping sets in brackets):

- ``lines``: lineitem joined to orders and (left) to part, which is the only
  pass over lineitem, shuffled twice (on the order key, then the part key;
  not at all where the rows come from line facts: then each set is an
  aggregate of its own, over its columns).
  Sets: [party, date] with line count, quantity, discount and name-length
  sums and the number of lines with a part; [party, date, has_part, brand];
  [party, date, has_part, name]; [party, date, supplier].
- ``orders``: sets [party, date] with order and status-F counts, and
  [party, date, customer].
- ``events``: sets [party, hour] with event count, count above 50 and value
  sum; and [party, hour, user], [party, hour, source], [party, hour, source
  mod 10].
- the latest lists, a bounded top-n per key, straight from events.

Hourly counts are also rolled up by day, for the month routes.

Bases and collections are published together, as one version
(:mod:`cubewise.sources.versions`): readers see the state before a build or
after it. Three builds change a published version:

- ``since``: all from a day's year on, from the raw rows of that time;
- ``days`` and ``event_days``: raw rows of just these days are read, and the
  cubes of their years are rolled up again from the bases;
- :func:`add_rows`: late rows are counted by themselves and added to the
  partitions of bases and cubes. No raw row that is counted already is read.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import LATEST_LIST_LENGTH
from ..functions.calendar import Window, day_windows, in_window
from ..sources.cubes import HISTORIC_PARTITIONS, LIVE_PARTITIONS
from ..sources.versions import Draft, Scope, Versions, folder_keys
from . import cubes as B
from .bindings import NUMBER, SUM, StoredCubes, TableCubes, day_rollup

GRAINS = ("year", "month", "week")
HOUR = ["party", "year", "month", "day", "hour"]
LINE_ITEMS = ["hashtag", "url", "taggedUser"]
ORDER_ITEMS = ["user"]
EVENT_ITEMS = ["username", "source", "hashtag"]
TOTAL = "total"
#: Lines, and rows of a base, that are aggregated by item at once, in bytes as
#: stored (whole years, at least one): their groups stay in the tasks' memory.
PORTION = 32 << 20
LINE_PORTION = 96 << 20


def _period(grain: str) -> list[Column]:
    return B.period_keys(grain, "date")


def _by_set(rows: DataFrame, keys: list[str], sets: list[list[str]], items: list[str], *aggs: Column, apart: bool = False) -> DataFrame:
    """One aggregate over grouping sets: ``keys`` alone (set ``total``) and
    with each of ``sets``. A set is named by the one of ``items`` it holds.

    With ``apart``, an aggregate for each set, which reads its own columns of
    ``rows`` only, and sums for items what cubes count of them: the first of
    ``aggs``. Where rows are stored, that is less work than grouping sets: these
    make a wide row for each set from every row, and all sets' groups share a
    task's memory, so that an item of very many values makes it spill.
    """
    if apart:
        out = rows.groupBy(*keys).agg(*aggs)
        columns = {c: rows.schema[c].dataType for s in sets for c in s} | {c: "string" for c in items} | {f.name: f.dataType for f in out.schema if f.name not in keys}

        def named(own: DataFrame, name: str) -> DataFrame:
            return own.select(*keys, *[(F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], F.lit(name).alias("set"))

        out = named(out, TOTAL)
        for s, name in zip(sets, items, strict=True):
            out = out.unionByName(named(rows.groupBy(*keys, *s).agg(aggs[0]), name))
        return out
    extra = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([keys, *[keys + s for s in sets]], *keys, *extra).agg(
        *aggs, *[F.grouping(item).alias(f"g_{item}") for item in items])
    name = F.coalesce(*[F.when(F.col(f"g_{item}") == 0, item) for item in items], F.lit(TOTAL))
    return out.withColumn("set", name).drop(*[f"g_{item}" for item in items])


def _only(base: DataFrame, item: str = TOTAL) -> DataFrame:
    """Rows of one grouping set: a partition filter."""
    return base.where(F.col("set") == item)


def lines_base(src: TableCubes, window: Window | tuple[Window, ...] | None = None) -> DataFrame:
    rows = src.line_rows(window).select(
        "party", F.to_date("ts").alias("date"), "has_part", "hashtag", "url", F.col("l_suppkey").cast("bigint" if src.joined else "string").alias("taggedUser"),
        "l_quantity", "l_discount", F.length("url").alias("name_len"))
    return _by_set(
        rows, ["party", "date"], [["has_part", "hashtag"], ["has_part", "url"], ["taggedUser"]], LINE_ITEMS,
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.col("l_discount") * 100).alias("disc100"),
        F.sum("name_len").alias("name_len"),
        F.sum(F.col("has_part").cast("int")).alias("parted"), apart=src.joined)


def line_bases(src: TableCubes, windows: tuple[Window, ...] | None) -> list[DataFrame]:
    """The lines base in parts, to be written one after another: of as many
    years each as are counted at once (of raw tables, whose lines have no year
    before their join, all)."""
    first = windows[0][0] if windows else dt.datetime.min
    spans = [(max(start, first), end) for start, end in src.spans(LINE_PORTION) if end > first]
    return [lines_base(src, (span,)) for span in spans] or [lines_base(src, windows)]


def orders_base(src: TableCubes, window: Window | tuple[Window, ...] | None = None) -> DataFrame:
    rows = src.orders(window, "o_orderstatus", "o_custkey").select(
        "party", F.to_date("ts").alias("date"), "o_orderstatus", F.col("o_custkey").cast("string").alias("user"))
    return _by_set(
        rows, ["party", "date"], [["user"]], ORDER_ITEMS,
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f_orders"))


def events_base(src: TableCubes, window: Window | tuple[Window, ...] | None = None) -> DataFrame:
    k = F.get_json_object(F.col("props"), "$.k")
    rows = src.events(window).select("party", *B.hour_keys(), F.col("user_id").cast("string").alias("username"),
                               k.alias("source"), (k.cast("long") % 10).cast("string").alias("hashtag"), "value")
    return _by_set(
        rows, HOUR, [[i] for i in EVENT_ITEMS], EVENT_ITEMS,
        F.count(F.lit(1)).cast("double").alias("events"),
        F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).cast("double").alias("media"),
        F.sum("value").alias("value_sum"))


LINES, ORDERS, EVENTS, ORDER_DAY, LATEST = "_base/lines", "_base/orders", "_base/events", "_base/order_day", "_base/latest"


# Value cubes rolled up from the day base: collection -> (sum, number it is divided by).
def _value_measures() -> dict[str, tuple[Column, Column | None]]:
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return {
        "countTotal": (total("orders"), None),
        "avgReplies": (total("lines"), total("orders")),
        "avgLikes": (F.sum("qty"), total("lines")),
        "avgRetweets": (F.sum("disc100"), total("lines")),
        "avgTweetLength": (F.sum("name_len"), total("parted")),
        "mediaUsage": (total("f_orders") * 100.0, total("orders")),
        "totalReplies": (total("lines"), None),
    }


def value_cube(order_day: DataFrame, collection: str, grain: str) -> DataFrame:
    """A value cube as it is stored: its count, or the sum and number of its mean."""
    total, number = _value_measures()[collection]
    aggs = [total.cast("double").alias("count")] if number is None else [total.cast("double").alias(SUM), number.cast("double").alias(NUMBER)]
    return order_day.groupBy("party", *_period(grain)).agg(*aggs)


def item_rollup(rows: DataFrame, item: str, grain: str, weight: str, item_expr: Column | None = None) -> DataFrame:
    """Sum ``weight`` of day-level rows by (party, period, item)."""
    if item_expr is not None:
        rows = rows.withColumn(item, item_expr)
    return (rows.groupBy("party", *_period(grain), F.col(item).cast("string").alias(item))
            .agg(F.sum(weight).cast("double").alias("count")))


def _historic_jobs(lines: list[DataFrame], orders: list[DataFrame], order_day: DataFrame, grain: str):
    """(rows, collection, grain, meta) of the cubes over orders and lines, whose
    bases come in portions that share no period."""
    count, name = {"measure": "count"}, "week" if grain == B.ISO_WEEK else grain
    for collection, (_, number) in _value_measures().items():
        yield value_cube(order_day, collection, grain), collection, name, count | ({"mean": True} if number is not None else {})
    yield item_rollup(order_day.where("orders > 0"), "weekday", grain, "orders", F.date_format("date", "EEEE")), "mostTweetsDay", name, count
    yield [item_rollup(_only(o, "user"), "user", grain, "orders") for o in orders], "mostActiveUsers", name, count
    yield [item_rollup(_only(li, "hashtag").where("has_part"), "hashtag", grain, "lines") for li in lines], "hashtags", name, count
    yield [item_rollup(_only(li, "url").where("has_part"), "url", grain, "lines") for li in lines], "urls", name, count
    yield [item_rollup(_only(li, "taggedUser"), "taggedUser", grain, "lines") for li in lines], "mostTaggedUsers", name, count


def _hour_of_day_jobs(events: DataFrame, grain: str):
    by_day = _only(events).withColumn("date", F.make_date("year", "month", "day"))
    yield item_rollup(by_day, "hour", grain, "events", F.col("hour")), "mostTweetsTime", "week" if grain == B.ISO_WEEK else grain, {"measure": "count"}


def _live_jobs(events: DataFrame):
    """(rows, collection, None, meta) of the hourly cubes."""
    hours, count = _only(events), {"measure": "count"}
    yield hours.select(*HOUR, F.col("events").alias("count")), "metricsByHourAndParty", None, count
    yield hours.select(*HOUR, F.col("media").alias("count")), "mediaUsageRunningByHourAndParty", None, count
    yield (hours.select(*HOUR, F.col("value_sum").alias(SUM), F.col("events").alias(NUMBER)), "sentimentRunningByHourAndParty", None,
           {"measure": "sentiment", "mean": True})
    for item, collection in (("username", "mostActiveRunningByHourAndParty"),
                             ("source", "sourceRunningByHourAndParty"), ("hashtag", "hashtagsByHourAndParty")):
        yield _only(events, item).select(*HOUR, item, F.col("events").alias("count")), collection, None, count


def _day_jobs(events: DataFrame):
    """(rows, collection, meta) of the day rollups that month routes read instead of hours."""
    hours, count = _only(events), {"measure": "count"}
    day = HOUR[:-1]
    for column, collection in (("events", "metricsByHourAndParty"), ("media", "mediaUsageRunningByHourAndParty")):
        yield hours.groupBy(*day).agg(F.sum(column).alias("count")), collection, count
    for item, collection in (("username", "mostActiveRunningByHourAndParty"),
                             ("source", "sourceRunningByHourAndParty"), ("hashtag", "hashtagsByHourAndParty")):
        yield _only(events, item).groupBy(*day, item).agg(F.sum("events").alias("count")), collection, count


def _with_year(base: DataFrame) -> DataFrame:
    return base if "year" in base.columns else base.withColumn("year", F.year("date").cast("long"))


def _order_day(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per party and day, the size of a day cube: written once, as 24
    rollups read it. Late lines may come without an order of their day."""
    line_day = _only(lines).select("party", "date", "year", "lines", "qty", "disc100", "name_len", "parted")
    return _only(orders).select("party", "date", "year", "orders", "f_orders").join(line_day, ["party", "date", "year"], "full")


class _Build:
    """One build: the parts of the new version that it writes."""

    def __init__(self, src: TableCubes, root: str, parallel: int):
        self.src, self.parallel = src, parallel
        self.target = StoredCubes(src.spark, root)
        self.draft: Draft = Versions(src.spark, root).draft()
        self.written: list[str] = []

    def same_weeks(self) -> None:
        """A version is changed by a source of the same weeks only."""
        held = self.draft.collections.get(self.target.name("countTotal", "week"))
        if held is not None and held.meta.get("weeks", B.CALENDAR) != self.src.weeks:
            raise ValueError(f"the cubes have {held.meta.get('weeks', B.CALENDAR)!r} weeks, not {self.src.weeks!r}: build them in full")

    def base(self, name: str, rows: DataFrame | list[DataFrame], replaces: Scope | None, unchanged: Column | None = None, adds: bool = False) -> None:
        """Write a base, by year and grouping set. Of a replaced year, rows
        for which ``unchanged`` holds are taken from the version before."""
        rows = [_with_year(r) for r in (rows if isinstance(rows, list) else [rows])]
        if unchanged is not None and name in self.draft.collections:
            rows.append(self.draft.frame(name, replaces).where(unchanged).select(rows[0].columns))
            rows = [reduce(DataFrame.unionByName, rows)]
        by_set = "set" in rows[0].columns
        self.draft.write(rows, name, ("year", "set") if by_set else ("year",), replaces, adds, clustered=by_set and unchanged is None)

    def rows(self, name: str, scope: Scope | None) -> DataFrame:
        return self.draft.frame(name, scope)

    def portions(self, name: str, scope: Scope | None) -> list[DataFrame]:
        """Rows of a base, in frames of whole years."""
        def within(some: set[str]) -> Scope:
            return lambda k: k["year"] in some and (scope is None or scope(k))

        keys = [folder_keys(f) for f in self.draft.collections[name].folders]
        scopes = [within(some) for some in self.draft.portions(name, "year", PORTION)]
        return [self.rows(name, own) for own in scopes if any(map(own, keys))] or [self.rows(name, scope)]

    def collections(self, jobs, replaces: dict[bool, Scope | None], adds: bool = False) -> None:
        """Write collections; ``replaces`` is given for live and historic ones.
        Rollups read small bases: running their jobs side by side keeps the
        executors busy instead of paying each small job's latency in turn.
        Historic ones are written as their aggregate's shuffle left them; by
        day, that would be many small files, so live ones are clustered first."""
        def write(job) -> str:
            rows, collection, grain, meta = job
            live = grain is None
            meta = meta | {"weeks": self.src.weeks} if grain == "week" else meta
            self.draft.write(rows, self.target.name(collection, grain), LIVE_PARTITIONS if live else HISTORIC_PARTITIONS, replaces[live], adds, meta,
                             clustered=not live)
            return self.target.path(collection, grain)

        with ThreadPoolExecutor(max_workers=self.parallel) as pool:
            self.written += pool.map(write, jobs)

    def day_rollups(self, events: DataFrame, replaces: Scope | None, adds: bool = False) -> None:
        """Write the day rollups of hourly cubes, beside them in the same version."""
        def write(job) -> None:
            rows, collection, meta = job
            self.draft.write(rows, day_rollup(collection), LIVE_PARTITIONS, replaces, adds, meta)

        with ThreadPoolExecutor(max_workers=self.parallel) as pool:
            list(pool.map(write, _day_jobs(events)))

    def latest(self, windows: tuple[Window, ...] | None, adds: bool = False) -> None:
        """The latest lists, kept as rows (key, ts, oid), at most n per key. An
        incremental build keeps the stored rows outside its windows and adds
        those inside; where a full list is short then (posts have gone), the
        rows beyond it were never stored, and the lists are built from all posts."""
        n, src, draft = LATEST_LIST_LENGTH, self.src, self.draft
        stored = draft.frame(LATEST) if LATEST in draft.collections and (windows is not None or adds) else None
        rows = B.newest_rows(src.events(None if stored is None else windows), "event_id")
        if stored is not None:
            before = (stored if adds else stored.where(~in_window("ts", windows, stored.schema["ts"].dataType.simpleString()))).select("key", "ts", "oid")
            rows = B.keep_newest(before.unionByName(rows), n)
        draft.write(rows, LATEST)
        if stored is not None and not adds:
            had = stored.groupBy("key").agg(F.count("oid").alias("had"))
            have = draft.frame(LATEST).groupBy("key").agg(F.count("oid").alias("have"))
            short = had.join(have, "key", "left").where((F.col("had") >= n) & (F.coalesce("have", F.lit(0)) < n))
            if not short.isEmpty():
                draft.write(B.newest_rows(src.events(None), "event_id"), LATEST)
        draft.write(B.lists_from_rows(draft.frame(LATEST)), "lastTweets")
        self.written.append(self.target.path("lastTweets"))

    def publish(self) -> list[str]:
        self.draft.publish()
        return self.written


def _in_years(years: set[int]) -> Scope:
    return lambda k: k["year"] in {str(y) for y in years}


def _since(year: int) -> Scope:
    return lambda k: k["year"].isdigit() and int(k["year"]) >= year


def _iso_scopes(days: list[dt.date] | None, since: dt.date | None) -> tuple[Scope | None, Scope | None, Column | None]:
    """Of week cubes by ISO week-year: the partitions that a change of these
    days (or of all since the first day of a year) replaces, the calendar
    years that hold their days, and the days of these years that count."""
    year = B.period_keys(B.ISO_WEEK, "date")[0]
    if since is not None:
        first = dt.date(since.year, 1, 1).isocalendar().year
        return _since(first), _since(first - 1), year >= first
    if days is None:
        return None, None, None
    years = {d.isocalendar().year for d in days}
    return _in_years(years), _in_years({y + k for y in years for k in (-1, 0, 1)}), year.isin(sorted(years))


def build_all(src: TableCubes, root: str, parallel: int = 4, since: dt.date | None = None, days: list[dt.date] | None = None,
              event_days: list[dt.date] | None = None) -> list[str]:
    """Publish all 46 collections under ``root`` as one version (read by
    :class:`StoredCubes`); the paths of those that were written.

    With ``since``, raw rows are read only from the first day of ``since``'s
    year on (the window reaches the scans of orders and events), and the bases
    and cubes of those years are replaced, also where they have no rows any
    more. With ``days`` (of orders) or ``event_days``, only raw rows of these
    days are read; of their years, the bases keep the other days, and the
    cubes are rolled up again from the bases. Neither reads raw lines of other
    years where ``src`` has line facts (:class:`~cubewise.plans.facts.FactCubes`).
    Without any, everything is rebuilt and replaced.
    """
    build = _Build(src, root, parallel)
    if since is not None or days is not None or event_days is not None:
        build.same_weeks()
    if days is None and event_days is None:
        windows = None if since is None else ((dt.datetime(since.year, 1, 1), dt.datetime(9999, 1, 1)),)
        scope = None if since is None else _since(since.year)
        build.base(LINES, line_bases(src, windows), scope)
        build.base(ORDERS, orders_base(src, windows), scope)
        build.base(EVENTS, events_base(src, windows), scope)
        _roll_up(build, scope, scope, scope, windows, iso=(_iso_scopes(None, since),) * 2)
        return build.publish()
    days, event_days = sorted(set(days or ())), sorted(set(event_days or ()))
    years, event_years = {d.year for d in days}, {d.year for d in event_days}
    windows, event_windows = day_windows(days), day_windows(event_days)
    if days:
        others = ~F.col("date").isin(days)
        build.base(LINES, lines_base(src, windows), _in_years(years), others)
        build.base(ORDERS, orders_base(src, windows), _in_years(years), others)
    if event_days:
        build.base(EVENTS, events_base(src, event_windows), _in_years(event_years), ~F.make_date("year", "month", "day").isin(event_days))
    at = {(str(d.year), str(d.month), str(d.day)) for d in event_days}
    live: Scope = lambda k: (k["year"], k["month"], k["day"]) in at
    _roll_up(build, _in_years(years), _in_years(event_years), live, event_windows, bool(days), event_days,
             iso=(_iso_scopes(days, None), _iso_scopes(event_days, None)))
    return build.publish()


def _roll_up(build: _Build, scope: Scope | None, event_scope: Scope | None, live: Scope | None, event_windows,
             orders_too: bool = True, event_days: list[dt.date] | None = None, iso=()) -> None:
    """Write the cubes of the years in ``scope`` from the bases (of week cubes,
    the years in ``iso``); of ``event_days`` only, the hourly ones."""
    grains = [B.week_grain(g, build.src.weeks) for g in GRAINS]

    def by_grain(name: str, grain: str, scope: Scope | None, iso) -> tuple[DataFrame, Scope | None]:
        """Base rows of a grain's years, and the partitions they replace."""
        if grain != B.ISO_WEEK:
            return build.rows(name, scope), scope
        replaced, read, counted = iso
        rows = build.rows(name, read)
        if counted is not None:
            date = rows if "date" in rows.columns else rows.withColumn("date", F.make_date("year", "month", "day"))
            rows = date.where(counted).select(rows.columns)
        return rows, replaced

    if orders_too:
        build.base(ORDER_DAY, _order_day(build.rows(LINES, scope), build.rows(ORDERS, scope)), scope)
        for replaced, own in _alike([(g, by_grain(ORDER_DAY, g, scope, iso[0])[1]) for g in grains]):
            jobs = []
            for g in own:
                # the year partition is re-derived from the date by each rollup
                # an ISO week can have days of two years: its bases stay in one
                lines, orders, order_day = ([rows.drop("year") for rows in (
                    [by_grain(n, g, scope, iso[0])[0]] if g == B.ISO_WEEK or n == ORDER_DAY else build.portions(n, scope))]
                    for n in (LINES, ORDERS, ORDER_DAY))
                jobs += _historic_jobs(lines, orders, order_day[0], g)
            build.collections(jobs, {True: None, False: replaced})
    if event_days is None or event_days:
        for replaced, own in _alike([(g, by_grain(EVENTS, g, event_scope, iso[1])[1]) for g in grains]):
            build.collections([j for g in own for j in _hour_of_day_jobs(by_grain(EVENTS, g, event_scope, iso[1])[0], g)], {True: None, False: replaced})
        events = build.rows(EVENTS, event_scope)
        if event_days:
            events = events.where(F.make_date("year", "month", "day").isin(event_days))
        build.collections(list(_live_jobs(events)), {True: live, False: None})
        build.day_rollups(events, live)
        build.latest(event_windows)


def _alike(grains: list[tuple[str, Scope | None]]) -> list[tuple[Scope | None, list[str]]]:
    """Grains by the partitions they replace, to be written side by side."""
    out: list[tuple[Scope | None, list[str]]] = []
    for grain, scope in grains:
        own = next((o for s, o in out if s is scope), None)
        if own is None:
            out.append((scope, [grain]))
        else:
            own.append(grain)
    return out


def add_rows(late: TableCubes, root: str, parallel: int = 4) -> list[str]:
    """Publish a version with rows that came late added to it: ``late`` holds
    just them (see :class:`~cubewise.plans.bindings.LateRows`).

    Every base and cube is additive but the latest lists, which are merged and
    cut again: what the late rows come to is written beside what is there, and
    readers merge both. The work is that of the late rows; the next build of
    their years makes one row of each key again.
    """
    build = _Build(late, root, parallel)
    if build.draft.base.number == 0:
        raise FileNotFoundError(f"no version is published under {root}")
    build.same_weeks()

    def added(name: str, rows: DataFrame) -> DataFrame:
        build.base(name, rows, None, adds=True)
        return build.draft.own(name)

    lines, orders, events = (added(n, b(late)) for n, b in ((LINES, lines_base), (ORDERS, orders_base), (EVENTS, events_base)))
    order_day = added(ORDER_DAY, _order_day(lines, orders)).drop("year")
    lines, orders = lines.drop("year"), orders.drop("year")
    grains = [B.week_grain(g, late.weeks) for g in GRAINS]
    jobs = [j for g in grains for j in (*_historic_jobs([lines], [orders], order_day, g), *_hour_of_day_jobs(events, g))]
    build.collections(jobs + list(_live_jobs(events)), {True: None, False: None}, adds=True)
    build.day_rollups(events, None, adds=True)
    build.latest(None, adds=True)
    return build.publish()

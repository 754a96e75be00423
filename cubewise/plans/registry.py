"""Every route of every family, bound to parameters that select data in the
driver tables: the registered queries of ``__spark_entry__``."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import FAMILIES, LATEST, LIVE_ITEMS, LIVE_MEAN, LIVE_SUM, BY_NAME, Family
from ..operators.history import all_time_top_items, top_items
from ..session import checkpoint_dir
from ..sources.cubes import nest_id
from .bindings import StoredCubes, TableCubes, build_all
from .facts import FactCubes, Facts
from .routes import answer, historic_shape

# Parameters on the driver tables. Historic posts are orders (party = order
# priority, 1995-2001); the hour-of-day family and all live families read
# events (party = event type, January 2024).
HISTORIC_YEAR = 1997
HISTORIC_PARTY = "1-URGENT"
EVENT_YEAR = 2024
EVENT_PARTY = "click"
AS_OF = dt.date(2024, 1, 15)

# Places that registered answers are rounded to, so that two engines agree.
ORACLE_DIGITS = 6

EVENT_FAMILIES = ("mosttweetstime",)


@dataclass(frozen=True)
class RouteSpec:
    family: Family
    shape: str
    params: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def key(self) -> str:
        return f"{self.family.name}__{self.shape}"

    def run(self, cubes) -> DataFrame:
        return answer(cubes, self.family.name, self.shape, digits=ORACLE_DIGITS, **self.params)


def _params(fam: Family, shape: str) -> dict:
    live = fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS, LATEST)
    events = live or fam.name in EVENT_FAMILIES
    p: dict = {}
    if shape.endswith("party"):
        p["party"] = EVENT_PARTY if events else HISTORIC_PARTY
    if shape.startswith("year_"):
        p["year"] = EVENT_YEAR if events else HISTORIC_YEAR
    if fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        p["as_of"] = AS_OF
    return p


def route_specs() -> list[RouteSpec]:
    return [RouteSpec(f, s, _params(f, s)) for f in FAMILIES for s in f.shapes]


# One family of each answer group is also registered in its JSON document
# form (``<key>__json``), for every shape; the documents are parsed back, so
# that their content can be compared.
JSON_FAMILIES = ("countTweetByMonth", "mostUsedHashtags", "mostUsedHashtagsCloud", "countTotalRunning", "liveSentiment",
                 "liveSource", "liveTweets")


def json_specs() -> list[RouteSpec]:
    return [s for s in route_specs() if s.family.name in JSON_FAMILIES]


_SOURCES: dict[tuple[int, str], TableCubes] = {}


def table_cubes(spark: SparkSession, sf_dir: str) -> TableCubes:
    """One TableCubes per session and folder, so table handles (and their file
    listings) are shared by all registered queries."""
    key = (id(spark), sf_dir.rstrip("/"))
    cached = _SOURCES.get(key)
    if cached is None or cached.spark is not spark:
        cached = _SOURCES[key] = TableCubes(spark, sf_dir)
    return cached


_FACTS: dict[tuple[int, str], FactCubes] = {}
_STORED: dict[tuple[int, str], StoredCubes] = {}
_ISO: dict[tuple[int, str], TableCubes] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def fact_cubes(spark: SparkSession, sf_dir: str) -> FactCubes:
    """Line facts of the tables, built once per session and folder."""
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _FACTS or _FACTS[key].spark is not spark:
        root = _folder(spark, "facts")
        Facts(spark, root).build(table_cubes(spark, sf_dir))
        _FACTS[key] = FactCubes(spark, sf_dir, root)
    return _FACTS[key]


def stored_cubes(spark: SparkSession, sf_dir: str) -> StoredCubes:
    """All collections of the tables, published once per session and folder."""
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _STORED or _STORED[key].spark is not spark:
        root = _folder(spark, "cubes")
        build_all(fact_cubes(spark, sf_dir), root)
        _STORED[key] = StoredCubes(spark, root)
    return _STORED[key]


def document_cubes(spark: SparkSession, sf_dir: str, spec: RouteSpec) -> StoredCubes:
    """The route's collection as JSON documents with the keys in ``_id``."""
    fam, stored = spec.family, StoredCubes(spark, _folder(spark, "documents"), fmt="json")
    grain = historic_shape(spec.shape)[0] if spec.family.name in HISTORIC_DOCUMENTS else None
    cube = table_cubes(spark, sf_dir).cube(fam.cube, grain)
    nest_id(cube, [c for c in cube.columns if c != fam.measure]).write.json(stored.path(fam.cube, grain))
    return stored


def iso_cubes(spark: SparkSession, sf_dir: str) -> TableCubes:
    """Cubes whose weeks belong to ISO week-years."""
    key = (id(spark), sf_dir.rstrip("/"))
    if key not in _ISO or _ISO[key].spark is not spark:
        _ISO[key] = TableCubes(spark, sf_dir, weeks="iso")
    return _ISO[key]


ISO_FAMILIES = ("countTweetByMonth", "averageReply", "averagelikestweet", "mostUsedHashtags", "mosttweetsday")
HISTORIC_DOCUMENTS = ("mostUsedHashtags",)
LINE_FAMILIES = ("averageReply", "averagelikestweet", "averageTweetLength", "averageRetweetsTweet", "totalReplies", "mostUsedHashtags",
                 "mostUsedHashtagsCloud", "mostTaggedUser", "mostUsedUrls")
STORED_ROUTES = ("mostUsedHashtags__year_month_party", "averagelikestweet__year_week", "mosttweetstime__legislatur", "liveSentiment__month",
                 "countTotalRunning__day_party", "liveSource__day", "liveTweets__all")
DOCUMENT_ROUTES = ("mostUsedHashtags__year_month", "liveSource__month")
ORDERED_ROUTES = ("countTweetByMonth__all", "mostUsedHashtags__year_month", "mosttweetsday__year_month", "countTotalRunning__month", "liveTweets__party")
WIDE_SHAPES = ("all", "year_month", "legislatur", "party")


def in_order(spec: RouteSpec, cubes: TableCubes) -> DataFrame:
    """A sorted answer with the position of each row, counted after the sort."""
    rows = answer(cubes, spec.family.name, spec.shape, digits=ORACLE_DIGITS, ordered=True, **spec.params)
    return rows.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def top_users(cubes: TableCubes | StoredCubes, shape: str, pruned: bool = False) -> DataFrame:
    """The unranked top 100 over an item with far more values than that."""
    n = BY_NAME["mostUsedHashtagsCloud"].n
    grain, one_year, one_party = historic_shape(shape)
    cube = cubes.cube("mostActiveUsers", grain)
    if shape == "legislatur":
        return all_time_top_items(cube, "user", n, pruned=pruned)
    return top_items(cube, "user", grain, n, HISTORIC_YEAR if one_year else None, HISTORIC_PARTY if one_party else None, ranked=False)


def extra_queries() -> dict:
    """Routes answered from facts, from published cubes and from documents, in
    the order they are served in, from an allow-list, and with a cut at 100."""
    specs = {s.key: s for s in route_specs()}
    out = {}

    def put(prefix: str, key: str, run) -> None:
        out[f"{prefix}_{key.replace('__', '_')}"] = lambda spark, sf_dir: run(spark, sf_dir, specs[key])

    for name in LINE_FAMILIES:
        put("facts", f"{name}__year_month", lambda spark, sf_dir, s: s.run(fact_cubes(spark, sf_dir)))
    for key in STORED_ROUTES:
        put("stored", key, lambda spark, sf_dir, s: s.run(stored_cubes(spark, sf_dir)))
    for key in DOCUMENT_ROUTES:
        put("documents", key, lambda spark, sf_dir, s: s.run(document_cubes(spark, sf_dir, s)))
    for key in ORDERED_ROUTES:
        put("ordered", key, lambda spark, sf_dir, s: in_order(s, table_cubes(spark, sf_dir)))
    put("allowed", "countTweetByMonth__party", lambda spark, sf_dir, s: answer(
        table_cubes(spark, sf_dir), s.family.name, s.shape, digits=ORACLE_DIGITS, allowed_parties=(HISTORIC_PARTY, "2-HIGH"), **s.params))
    out["top100_users_pruned"] = lambda spark, sf_dir: top_users(stored_cubes(spark, sf_dir), "legislatur", pruned=True)
    for name in ISO_FAMILIES:
        for shape in ("year_week", "year_week_party"):
            put("iso", f"{name}__{shape}", lambda spark, sf_dir, s: s.run(iso_cubes(spark, sf_dir)))
    for shape in WIDE_SHAPES:
        out[f"top100_users_{shape}"] = lambda spark, sf_dir, shape=shape: top_users(table_cubes(spark, sf_dir), shape)
    return out


def registered_queries() -> dict:
    """``key -> (spark, sf_dir) -> DataFrame`` for every route, plus the
    parsed JSON documents of :data:`JSON_FAMILIES`."""
    from .documents import document_rows, route_json

    out = {}
    for spec in route_specs():
        def run(spark: SparkSession, sf_dir: str, _spec: RouteSpec = spec) -> DataFrame:
            return _spec.run(table_cubes(spark, sf_dir))
        out[spec.key] = run
    for spec in json_specs():
        def run_json(spark: SparkSession, sf_dir: str, _spec: RouteSpec = spec) -> DataFrame:
            docs = route_json(table_cubes(spark, sf_dir), _spec.family.name, _spec.shape, digits=ORACLE_DIGITS, **_spec.params)
            return document_rows(docs, _spec.family.name, _spec.shape)
        out[f"{spec.key}__json"] = run_json
    return out | extra_queries()

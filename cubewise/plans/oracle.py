"""Independent DuckDB SQL for every registered route (the correctness oracle).

Written directly against the raw driver tables, without the Spark code's
shortcuts (for example, line means are plain ``AVG`` over the joined lines
here, while the Spark plan sums per order first). Same tiebreaks (total
descending, item ascending), same rounding (means to 6 places) and the same
column names and types as the Spark results.

Nothing is taken from the rest of the library: families, cube and item names,
each N, parameters and the calendar are stated here once more, so a change
there shows as a difference.
"""

from __future__ import annotations

from typing import NamedTuple

COUNT, RANKED, UNRANKED = "count", "ranked", "unranked"
LIVE_SUM, LIVE_MEAN, LIVE_ITEMS, LATEST = "live sum", "live mean", "live items", "latest"


class Family(NamedTuple):
    name: str
    group: str
    cube: str
    item: str | None = None
    n: int | None = None
    measure: str = "count"


# The served families.
FAMILIES = (
    Family("countTweetByMonth", COUNT, "countTotal"),
    Family("averageReply", COUNT, "avgReplies"),
    Family("averagelikestweet", COUNT, "avgLikes"),
    Family("averageTweetLength", COUNT, "avgTweetLength"),
    Family("averageRetweetsTweet", COUNT, "avgRetweets"),
    Family("mediausagetweets", COUNT, "mediaUsage"),
    Family("totalReplies", COUNT, "totalReplies"),
    Family("mostUsedHashtags", RANKED, "hashtags", "hashtag", 10),
    Family("mostUsedHashtagsCloud", UNRANKED, "hashtags", "hashtag", 100),
    Family("mosttweetsday", UNRANKED, "mostTweetsDay", "weekday", 7),
    Family("mosttweetstime", UNRANKED, "mostTweetsTime", "hour", 24),
    Family("mostActiveUser", RANKED, "mostActiveUsers", "user", 10),
    Family("mostTaggedUser", RANKED, "mostTaggedUsers", "taggedUser", 10),
    Family("mostUsedUrls", RANKED, "urls", "url", 10),
    Family("countTotalRunning", LIVE_SUM, "metricsByHourAndParty"),
    Family("liveMediaUsage", LIVE_SUM, "mediaUsageRunningByHourAndParty"),
    Family("liveSentiment", LIVE_MEAN, "sentimentRunningByHourAndParty", measure="sentiment"),
    Family("liveMostActiveUser", LIVE_ITEMS, "mostActiveRunningByHourAndParty", "username"),
    Family("liveSource", LIVE_ITEMS, "sourceRunningByHourAndParty", "source"),
    Family("liveHashtags", LIVE_ITEMS, "hashtagsByHourAndParty", "hashtag"),
    Family("liveTweets", LATEST, "lastTweets"),
)
PERIODS = ("all", "party", "year_month", "year_week", "year_month_party", "year_week_party")
DAYS = ("day", "day_party", "month", "month_party")
SHAPES = {COUNT: PERIODS, RANKED: PERIODS, UNRANKED: (*PERIODS, "legislatur"), LIVE_SUM: DAYS, LIVE_MEAN: DAYS, LIVE_ITEMS: DAYS, LATEST: ("all", "party")}
LIVE_MONTH_TOP_N = 10
LATEST_LIST_LENGTH = 15
COMBINED_KEY = "combined"
JSON_FAMILIES = ("countTweetByMonth", "mostUsedHashtags", "mostUsedHashtagsCloud", "countTotalRunning", "liveSentiment", "liveSource", "liveTweets")
# Parameters of the registered routes.
YEAR, EVENT_YEAR = 1997, 2024
PARTY, EVENT_PARTY = "1-URGENT", "click"
DAY, MONTH, DAYS_IN_MONTH = 15, 1, 31


class Route(NamedTuple):
    family: Family
    shape: str

    @property
    def key(self) -> str:
        return f"{self.family.name}__{self.shape}"

    @property
    def params(self) -> dict:
        events = self.family.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS, LATEST) or self.family.name == "mosttweetstime"
        return {"party": EVENT_PARTY if events else PARTY, "year": EVENT_YEAR if events else YEAR}


def routes() -> list[Route]:
    return [Route(f, s) for f in FAMILIES for s in SHAPES[f.group]]


def historic_shape(shape: str) -> tuple[str, bool, bool]:
    """(grain, one year, one party)."""
    grain = "month" if "month" in shape else "week" if "week" in shape else "year"
    return grain, shape.startswith("year_"), shape.endswith("party")


ORDERS = ("(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority AS party, o_orderdate AS ts "
          "FROM orders) o")
EVENTS = "(SELECT event_id, ts, user_id, event_type AS party, value, props FROM events) e"
HOUR_KEYS = ("CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, "
             "CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour")
K = "json_extract_string(props, '$.k')"


def lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def period_keys(grain: str) -> str:
    keys = ["CAST(year(ts) AS BIGINT) AS year"]
    if grain == "month":
        keys.append("CAST(month(ts) AS BIGINT) AS month")
    if grain == "week":
        keys.append("CAST(weekofyear(ts) AS BIGINT) AS week")
    return ", ".join(keys)


def historic_cube_sql(collection: str, grain: str) -> str:
    k = period_keys(grain)
    lines = f"lineitem l JOIN {ORDERS} ON l.l_orderkey = o.o_orderkey"
    with_part = f"{lines} JOIN part p ON l.l_partkey = p.p_partkey"
    body = {
        "countTotal": f"CAST(count(*) AS DOUBLE) AS count FROM {ORDERS}",
        "avgReplies": (f"AVG(COALESCE(c.n, 0)) AS count FROM {ORDERS} LEFT JOIN "
                       "(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) c "
                       "ON c.l_orderkey = o.o_orderkey"),
        "avgLikes": f"AVG(l.l_quantity) AS count FROM {lines}",
        "avgRetweets": f"AVG(l.l_discount * 100) AS count FROM {lines}",
        "avgTweetLength": f"AVG(length(p.p_name)) AS count FROM {with_part}",
        "mediaUsage": (f"AVG(CASE WHEN o_orderstatus = 'F' THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) "
                       f"AS count FROM {ORDERS}"),
        "totalReplies": (f"CAST(count(l.l_orderkey) AS DOUBLE) AS count FROM {ORDERS} "
                         "LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey"),
        "hashtags": f"p.p_brand AS hashtag, CAST(count(*) AS DOUBLE) AS count FROM {with_part}",
        "mostTweetsDay": f"dayname(ts) AS weekday, CAST(count(*) AS DOUBLE) AS count FROM {ORDERS}",
        "mostTweetsTime": f"CAST(hour(ts) AS VARCHAR) AS hour, CAST(count(*) AS DOUBLE) AS count FROM {EVENTS}",
        "mostActiveUsers": f'CAST(o_custkey AS VARCHAR) AS "user", CAST(count(*) AS DOUBLE) AS count FROM {ORDERS}',
        "mostTaggedUsers": (f"CAST(l.l_suppkey AS VARCHAR) AS taggedUser, CAST(count(*) AS DOUBLE) AS count "
                            f"FROM {lines}"),
        "urls": f"p.p_name AS url, CAST(count(*) AS DOUBLE) AS count FROM {with_part}",
    }[collection]
    return f"SELECT party, {k}, {body} GROUP BY ALL"


def live_cube_sql(collection: str) -> str:
    body = {
        "metricsByHourAndParty": "CAST(count(*) AS DOUBLE) AS count",
        "mediaUsageRunningByHourAndParty": "CAST(SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE) AS count",
        "sentimentRunningByHourAndParty": "AVG(value) AS sentiment",
        "mostActiveRunningByHourAndParty": "CAST(user_id AS VARCHAR) AS username, CAST(count(*) AS DOUBLE) AS count",
        "sourceRunningByHourAndParty": f"{K} AS source, CAST(count(*) AS DOUBLE) AS count",
        "hashtagsByHourAndParty": (f"CAST(CAST({K} AS BIGINT) % 10 AS VARCHAR) AS hashtag, "
                                   "CAST(count(*) AS DOUBLE) AS count"),
    }[collection]
    return f"SELECT party, {HOUR_KEYS}, {body} FROM {EVENTS} GROUP BY ALL"


def _where(*conds: str | None) -> str:
    conds = [c for c in conds if c]
    return ("WHERE " + " AND ".join(conds)) if conds else ""


def _historic(spec: Route) -> str:
    fam, shape, p = spec.family, spec.shape, spec.params
    grain, needs_year, needs_party = historic_shape(shape)
    cube = historic_cube_sql(fam.cube, grain)
    where = _where(f"year = {p['year']}" if needs_year else None,
                   f"party = {lit(p['party'])}" if needs_party else None)
    head = [] if needs_party else ["party"]
    if fam.group == COUNT:
        cols = ", ".join(head + [grain, "round(round(count, 9), 6) AS value"])
        return f"WITH cube AS ({cube}) SELECT {cols} FROM cube {where}"
    item = f'"{fam.item}"'
    groups = ["party"] if shape == "legislatur" else ["party", grain]
    cols = head + ([] if shape == "legislatur" else [grain])
    if fam.group == RANKED:
        cols.append("rank")
    cols += [item, "total"]
    return (f"WITH cube AS ({cube}), "
            f"t AS (SELECT {', '.join(groups)}, {item}, SUM(count) AS total FROM cube {where} GROUP BY ALL), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(groups)} "
            f"ORDER BY total DESC, {item} ASC) AS rank FROM t) "
            f"SELECT {', '.join(cols)} FROM r WHERE rank <= {fam.n}")


def _live(spec: Route) -> str:
    fam, shape, p = spec.family, spec.shape, spec.params
    one = shape.endswith("party")
    party = f"party = {lit(p['party'])}" if one else None
    cube = live_cube_sql(fam.cube)
    if shape.startswith("day"):
        y, m, d = EVENT_YEAR, MONTH, DAY
        where = _where(f"year = {y}", f"month = {m}", f"day = {d}", party)
        if fam.group == LIVE_SUM:
            return f"WITH cube AS ({cube}) SELECT party, SUM(count) AS total FROM cube {where} GROUP BY party"
        if fam.group == LIVE_MEAN:
            return (f"WITH cube AS ({cube}) SELECT party, round(round(AVG({fam.measure}), 9), 6) AS mean "
                    f"FROM cube {where} GROUP BY party")
        item = f'"{fam.item}"'
        return (f"WITH cube AS ({cube}), "
                f"t AS (SELECT party, {item}, SUM(count) AS total FROM cube {where} GROUP BY ALL), "
                f"r AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY total DESC, {item} ASC) AS rn "
                f"FROM t) SELECT party, {item} FROM r WHERE rn = 1")
    y, m, n_days = EVENT_YEAR, MONTH, DAYS_IN_MONTH
    where = _where(f"year = {y}", f"month = {m}", party)
    head = "" if one else "s.party, "
    spine_of = (lambda src: f"spine AS (SELECT q.party, CAST(d.range AS BIGINT) AS day "
                f"FROM (SELECT DISTINCT party FROM {src}) q CROSS JOIN range(1, {n_days + 1}) d)")
    if fam.group in (LIVE_SUM, LIVE_MEAN):
        if fam.group == LIVE_SUM:
            agg, name, value = "SUM(count)", "total", "COALESCE(daily.total, 0.0)"
        else:
            agg, name, value = f"AVG({fam.measure})", "mean", "round(round(COALESCE(daily.mean, 0.0), 9), 6)"
        return (f"WITH cube AS ({cube}), "
                f"daily AS (SELECT party, day, {agg} AS {name} FROM cube {where} GROUP BY ALL), "
                f"{spine_of('daily')} "
                f"SELECT {head}s.day, {value} AS {name} FROM spine s "
                f"LEFT JOIN daily ON s.party = daily.party AND s.day = daily.day")
    item = f'"{fam.item}"'
    head_r = "" if one else "party, "
    return (f"WITH cube AS ({cube}), "
            f"t AS (SELECT party, day, {item}, SUM(count) AS total FROM cube {where} GROUP BY ALL), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY party, day ORDER BY total DESC, {item} ASC) AS rn "
            f"FROM t), {spine_of('t')} "
            f"SELECT {head_r}day, {item}, total FROM r WHERE rn <= {LIVE_MONTH_TOP_N} "
            f"UNION ALL SELECT {head}s.day, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM spine s "
            f"WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.party = s.party AND t.day = s.day)")


def _latest(spec: Route) -> str:
    key = spec.params["party"] if spec.shape == "party" else COMBINED_KEY
    return ("WITH p AS (SELECT event_type AS key, ts, event_id FROM events "
            f"UNION ALL SELECT {lit(COMBINED_KEY)} AS key, ts, event_id FROM events), "
            "r AS (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) "
            "AS n FROM p) "
            f"SELECT key, n, CAST(event_id AS VARCHAR) AS tweet_id FROM r "
            f"WHERE n <= {LATEST_LIST_LENGTH} AND key = {lit(key)}")


def route_sql(spec: Route) -> str:
    if spec.family.group == LATEST:
        return _latest(spec)
    if spec.family.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        return _live(spec)
    return _historic(spec)


def json_sql(spec: Route) -> str:
    """The entries of a route's documents: keys as text, from the outside in."""
    fam, shape = spec.family, spec.shape
    top = [] if shape.endswith("party") else ["party"]
    value = "total"
    if fam.group == LATEST:
        keys, value = ["key", "n"], "tweet_id"
    elif shape == "legislatur":
        keys = ["party", fam.item]
    elif fam.group in (LIVE_SUM, LIVE_MEAN, LIVE_ITEMS):
        by_day = shape.startswith("day")
        keys = ["party"] if by_day else [*top, "day", *([fam.item] if fam.group == LIVE_ITEMS else [])]
        value = "mean" if fam.group == LIVE_MEAN else fam.item if fam.group == LIVE_ITEMS and by_day else "total"
    else:
        grain = "month" if "month" in shape else "week" if "week" in shape else "year"
        inner = {COUNT: [], RANKED: ["rank", fam.item]}.get(fam.group, [fam.item])
        keys = [*top, grain, *inner]
        if fam.group == COUNT:
            value = "value"
    padded = [f"lpad(CAST({k} AS VARCHAR), 2, '0')" if fam.group == COUNT and k in ("month", "week") else f'CAST("{k}" AS VARCHAR)'
              for k in keys]
    cols = ", ".join(f"{c} AS k{i}" for i, c in enumerate(padded, 1))
    return f'SELECT {cols}, "{value}" AS value FROM ({route_sql(spec)}) answer'


def registered_sql() -> dict[str, str]:
    return {r.key: route_sql(r) for r in routes()} | {f"{r.key}__json": json_sql(r) for r in routes() if r.family.name in JSON_FAMILIES} | extra_sql()


def _route(key: str) -> Route:
    return {r.key: r for r in routes()}[key]


def _cloud(shape: str) -> str:
    """Customers as items of the unranked top 100, so that the cut is reached."""
    wide = Family("", UNRANKED, "mostActiveUsers", "user", 100)
    return _historic(Route(wide, shape))


def _ordered(key: str, *order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) AS position FROM ({route_sql(_route(key))}) answer"


def extra_sql() -> dict[str, str]:
    """Routes answered another way (from facts, from stored cubes, in order, over many items) have the same answers."""
    out = {}
    for name in ("averageReply", "averagelikestweet", "averageTweetLength", "averageRetweetsTweet", "totalReplies", "mostUsedHashtags",
                 "mostUsedHashtagsCloud", "mostTaggedUser", "mostUsedUrls"):
        out[f"facts_{name}_year_month"] = route_sql(_route(f"{name}__year_month"))
    for key in ("mostUsedHashtags__year_month_party", "averagelikestweet__year_week", "mosttweetstime__legislatur", "liveSentiment__month",
                "countTotalRunning__day_party", "liveSource__day", "liveTweets__all"):
        out["stored_" + key.replace("__", "_")] = route_sql(_route(key))
    for key in ("mostUsedHashtags__year_month", "liveSource__month"):
        out["documents_" + key.replace("__", "_")] = route_sql(_route(key))
    out["ordered_countTweetByMonth_all"] = _ordered("countTweetByMonth__all", "party", "year")
    out["ordered_mostUsedHashtags_year_month"] = _ordered("mostUsedHashtags__year_month", "party", "month", "rank")
    out["ordered_mosttweetsday_year_month"] = _ordered("mosttweetsday__year_month", "party", "month", "total DESC", "weekday")
    out["ordered_countTotalRunning_month"] = _ordered("countTotalRunning__month", "party", "day")
    out["ordered_liveTweets_party"] = _ordered("liveTweets__party", "key", "n")
    for name in ("countTweetByMonth", "averageReply", "averagelikestweet", "mostUsedHashtags", "mosttweetsday"):
        for shape in ("year_week", "year_week_party"):  # the week's own year, not its day's
            out[f"iso_{name}_{shape}"] = route_sql(_route(f"{name}__{shape}")).replace("CAST(year(ts) AS BIGINT) AS year", "CAST(isoyear(ts) AS BIGINT) AS year")
    for shape in ("all", "year_month", "legislatur", "party"):
        out[f"top100_users_{shape}"] = _cloud(shape)
    out["top100_users_pruned"] = _cloud("legislatur")
    out["allowed_countTweetByMonth_party"] = route_sql(_route("countTweetByMonth__party"))
    return out

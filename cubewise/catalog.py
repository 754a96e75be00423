"""The 21 route families as data (what each one reads and how it answers).

Every family names the cube collection(s) it reads, the shape group that
answers it, the item field for item cubes, the N of its top-N and the name
of the measure field.
"""

from __future__ import annotations

from dataclasses import dataclass

# Shape groups, and the route shapes each one answers.
COUNT = "count"            # values per period
RANKED = "ranked"          # ranked top-N items per period
UNRANKED = "unranked"      # top-N items per period, rank not shown
LIVE_SUM = "live_sum"      # day total / zero-filled month of daily totals
LIVE_MEAN = "live_mean"    # day mean / zero-filled month of daily means
LIVE_ITEMS = "live_items"  # leading item today / top items per day this month
LATEST = "latest"          # newest-first id lists

SHAPES = {
    COUNT: ("all", "party", "year_month", "year_week", "year_month_party", "year_week_party"),
    RANKED: ("all", "party", "year_month", "year_week", "year_month_party", "year_week_party"),
    UNRANKED: ("all", "legislatur", "party", "year_month", "year_week",
               "year_month_party", "year_week_party"),
    LIVE_SUM: ("day", "day_party", "month", "month_party"),
    LIVE_MEAN: ("day", "day_party", "month", "month_party"),
    LIVE_ITEMS: ("day", "day_party", "month", "month_party"),
    LATEST: ("all", "party"),
}


@dataclass(frozen=True)
class Family:
    name: str
    group: str
    cube: str                 # collection base name (historic: + ByYear/ByMonth/ByWeek)
    item: str | None = None   # item field inside the cube key
    n: int | None = None      # N of the top-N
    measure: str = "count"    # measure field of the cube

    @property
    def shapes(self) -> tuple[str, ...]:
        return SHAPES[self.group]

    def collection(self, grain: str | None = None) -> str:
        """Collection name for a grain: historic cubes exist per year/month/week."""
        if grain is None:
            return self.cube
        return f"{self.cube}By{grain.capitalize()}"


# Route family names, cube collection names, item field names
# and N, as the served routes define them (route order as registered).
FAMILIES: tuple[Family, ...] = (
    Family("countTweetByMonth", COUNT, "countTotal"),
    Family("averageReply", COUNT, "avgReplies"),
    Family("averagelikestweet", COUNT, "avgLikes"),
    Family("averageTweetLength", COUNT, "avgTweetLength"),
    Family("averageRetweetsTweet", COUNT, "avgRetweets"),
    Family("mediausagetweets", COUNT, "mediaUsage"),
    Family("totalReplies", COUNT, "totalReplies"),
    Family("mostUsedHashtags", RANKED, "hashtags", item="hashtag", n=10),
    Family("mostUsedHashtagsCloud", UNRANKED, "hashtags", item="hashtag", n=100),
    Family("mosttweetsday", UNRANKED, "mostTweetsDay", item="weekday", n=7),
    Family("mosttweetstime", UNRANKED, "mostTweetsTime", item="hour", n=24),
    Family("mostActiveUser", RANKED, "mostActiveUsers", item="user", n=10),
    Family("mostTaggedUser", RANKED, "mostTaggedUsers", item="taggedUser", n=10),
    Family("mostUsedUrls", RANKED, "urls", item="url", n=10),
    Family("countTotalRunning", LIVE_SUM, "metricsByHourAndParty"),
    Family("liveMediaUsage", LIVE_SUM, "mediaUsageRunningByHourAndParty"),
    Family("liveSentiment", LIVE_MEAN, "sentimentRunningByHourAndParty", measure="sentiment"),
    Family("liveMostActiveUser", LIVE_ITEMS, "mostActiveRunningByHourAndParty", item="username"),
    Family("liveSource", LIVE_ITEMS, "sourceRunningByHourAndParty", item="source"),
    Family("liveHashtags", LIVE_ITEMS, "hashtagsByHourAndParty", item="hashtag"),
    Family("liveTweets", LATEST, "lastTweets", measure="tweetIds"),
)

# The party allow-list for one-party routes of the original
# data set, and the N of the per-day top items in the live month routes.
PARTIES = ("CDU", "SPD", "FDP", "Linke", "B90", "AfD", "CSU", "Parteilos")
LIVE_MONTH_TOP_N = 10
LATEST_LIST_LENGTH = 15
COMBINED_KEY = "combined"

BY_NAME = {f.name: f for f in FAMILIES}


def family(name: str) -> Family:
    try:
        return BY_NAME[name]
    except KeyError:
        raise KeyError(f"unknown family {name!r}; known: {sorted(BY_NAME)}") from None


def check_party(party: str | None, allowed: tuple[str, ...] | None) -> None:
    """One-party routes accept only parties from the allow-list, when one is given."""
    if party is not None and allowed is not None and party not in allowed:
        raise ValueError(f"party {party!r} is not one of {allowed}")

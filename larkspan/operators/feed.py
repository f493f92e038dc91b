"""Personalised feed ranking, stacks, rails and related event lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import geo, scoring

HOUR, DAY = 3600.0, 86400.0


def seconds_until(at: Column, now: Column) -> Column:
    return F.unix_seconds(at) - F.unix_seconds(now)


def going_counts(attendees: DataFrame) -> DataFrame:
    return attendees.groupBy("event_id").agg(F.count_if(F.col("status") == "going").alias("attendee_count"))


def with_attendees(events: DataFrame, attendees: DataFrame) -> DataFrame:
    return events.join(going_counts(attendees), "event_id", "left").withColumn("attendee_count", F.coalesce("attendee_count", F.lit(0)))


def scored(events: DataFrame, now: Column, lat: float | None, lng: float | None, radius_km: float, preferred: list[str], mode: str | None = None, is_parent: bool = False) -> DataFrame:
    """Adds distance_km and the parts of the score to events with attendee_count."""
    distance = geo.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) if lat is not None and lng is not None else F.lit(None).cast("double")
    left = seconds_until(F.col("event_date"), now)
    out = events.withColumn("distance_km", distance)
    return out.withColumns({
        "category_score": scoring.category_score(F.col("category"), preferred),
        "time_score": scoring.time_score(left / DAY),
        "social_score": scoring.social_score(F.col("attendee_count")),
        "match_score": scoring.match_score(F.col("match_percentage")),
        "distance_score": scoring.distance_score(F.col("distance_km"), radius_km),
        "urgency": scoring.urgency_boost(left / HOUR),
        "trending": scoring.trending_boost(F.col("attendee_count")),
        "mode_factor": scoring.mode_multiplier(F.col("category"), mode, is_parent),
    })


def _base() -> Column:
    return scoring.base_score({name: F.col(f"{name}_score") for name in scoring.WEIGHTS})


def personalised_feed(events: DataFrame, attendees: DataFrame, hosts: DataFrame, now: Column, lat: float, lng: float, radius_km: float = 25.0, preferred: list[str] = (), mode: str | None = None, is_parent: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
    """The feed as the server ranks it: events within the radius, the whole score capped at 1.5, ties by event_id.

    The box around the radius is a filter on columns of events; counts aggregate before their join; hosts join on the
    ranked page only, so no more than a page of rows meets them.
    """
    near = events.filter(geo.within_box(F.col("lat"), F.col("lng"), lat, lng, radius_km))
    ranked = scored(with_attendees(near, attendees), now, lat, lng, radius_km, list(preferred), mode, is_parent).filter(F.col("distance_km") <= radius_km)
    final = F.least(F.lit(1.5), _base() * F.col("urgency") * F.col("trending") * F.col("mode_factor"))
    page = ranked.withColumn("final_score", final).orderBy(F.desc("final_score"), "event_id").offset(offset).limit(limit)
    return page.join(hosts, page["created_by"] == hosts["host_id"], "left").drop("host_id")


def client_rank(events: DataFrame, now: Column, lat: float | None, lng: float | None, radius_km: float, preferred: list[str], mode: str | None = None, is_parent: bool = False) -> DataFrame:
    """The score as the client ranks: no radius filter, the boosts capped together, thin entries penalised, no last cap."""
    ranked = scored(events, now, lat, lng, radius_km, preferred, mode, is_parent)
    final = _base() * F.least(F.col("urgency") * F.col("trending"), F.lit(1.5)) * F.col("mode_factor") * scoring.quality_penalty(F.col("image_url"), F.col("description"))
    return ranked.withColumn("final_score", final)


def nearby(events: DataFrame, attendees: DataFrame, lat: float, lng: float, radius_km: float, categories: list[str] | None = None, types: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events within a radius by distance, then date; optional filters are left out of the plan where not given."""
    near = events.filter(geo.within_box(F.col("lat"), F.col("lng"), lat, lng, radius_km))
    if categories:
        near = near.filter(F.col("category").isin(categories))
    if types:
        near = near.filter(F.col("event_type").isin(types))
    near = near.withColumn("distance_km", geo.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).filter(F.col("distance_km") <= radius_km)
    page = near.orderBy("distance_km", "event_date", "event_id").offset(offset).limit(limit)
    return with_attendees(page, attendees)


#: The categories and hours of each intent.
INTENT_CATEGORIES = {"lunch": ["dining", "food"], "coffee": ["cafe", "food"], "drinks": ["nightlife", "bar", "dining"], "explore": ["culture", "art", "music", "entertainment"]}
INTENT_HOURS = {"lunch": (11, 15), "coffee": (7, 18), "drinks": (17, 24), "explore": (0, 24)}


def mission_events(events: DataFrame, attendees: DataFrame, intent: str, lat: float | None, lng: float | None, hour: int, now: Column, radius_km: float = 1.0, limit: int = 10) -> DataFrame:
    """Events for an intent close by: category and hour gates, ordered by distance, with walking minutes.

    Raises without a location or for an unknown intent. Outside the intent's hours there are no rows.
    """
    if lat is None or lng is None:
        raise ValueError("a location is needed")
    if intent not in INTENT_CATEGORIES:
        raise ValueError(f"unknown intent: {intent}")
    low, high = INTENT_HOURS[intent]
    out = nearby(events.filter(F.col("event_date") >= F.date_trunc("day", now)), attendees, lat, lng, radius_km, INTENT_CATEGORIES[intent], limit=limit)
    return out.filter(F.lit(low <= hour < high)).withColumn("walking_minutes", geo.walking_minutes(F.col("distance_km")))


def mission_json(found: DataFrame) -> DataFrame:
    """One row with the events as JSON in order of distance; an empty list where there are none."""
    item = F.struct("distance_km", "event_id", "title", "category", "walking_minutes")
    listed = F.coalesce(F.array_sort(F.collect_list(item)), F.array())
    return found.agg(F.to_json(F.struct(listed.alias("events"))).alias("result"))


def friends_pulse(relations: DataFrame, attendees: DataFrame, events: DataFrame, user_id: int, now: Column) -> DataFrame:
    """What the people that a user follows go to from today on: live if it is today and has a time, upcoming within 24 hours, else future."""
    friends = relations.filter((F.col("follower_id") == user_id) & (F.col("status") == "accepted")).select(F.col("following_id").alias("profile_id")).distinct()
    went = attendees.filter(F.col("status") == "going").join(friends, "profile_id").select("profile_id", "event_id").distinct()
    coming = events.filter(F.col("event_date") >= F.date_trunc("day", now))
    left = seconds_until(F.col("event_date"), now)
    timed = F.col("event_time").isNotNull() & (F.col("event_time") != "")
    state = F.when((F.to_date("event_date") == F.to_date(now)) & timed, "live").when((left >= 0) & (left <= DAY), "upcoming").otherwise("future")
    return went.join(coming, "event_id").withColumn("pulse", state)


def stacks(events: DataFrame) -> DataFrame:
    """Anchors with their forks in order of time; forks whose anchor is missing, and signals, stand alone."""
    is_fork = F.col("event_type") == "fork"
    forks = events.filter(is_fork & F.col("parent_event_id").isNotNull())
    anchors = events.filter(F.col("event_type") == "anchor")
    nested = forks.groupBy(F.col("parent_event_id").alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_date", "event_id"))), lambda x: x["event_id"]).alias("forks"))
    with_forks = anchors.join(nested, "event_id", "left").select("event_id", F.lit("stack").alias("kind"), "event_date", F.coalesce("forks", F.array().cast("array<bigint>")).alias("forks"))
    orphans = forks.join(anchors.select(F.col("event_id").alias("parent_event_id")), "parent_event_id", "left_anti")
    singles = events.filter((F.col("event_type") == "signal") | (is_fork & F.col("parent_event_id").isNull())).unionByName(orphans)
    alone = singles.select("event_id", F.lit("single").alias("kind"), "event_date", F.array().cast("array<bigint>").alias("forks"))
    return with_forks.unionByName(alone)


#: A rail: its priority, and what it keeps and in which order.
Rail = tuple[int, Callable[[DataFrame, dict], DataFrame]]
RAILS: dict[str, Rail] = {}


def rail(name: str, priority: int):
    """Registers a rail; a later registration under the same name replaces it."""

    def keep(make: Callable[[DataFrame, dict], DataFrame]) -> Callable[[DataFrame, dict], DataFrame]:
        RAILS[name] = (priority, make)
        return make

    return keep


def _top(events: DataFrame, *order: Column) -> DataFrame:
    return events.orderBy(*order, "event_id").limit(10)


@rail("for-you", 1)
def for_you(events: DataFrame, context: dict) -> DataFrame:
    chosen = context.get("categories") or []
    kept = events.filter(F.col("category").isin(chosen)) if chosen else events
    return _top(kept, F.desc(F.coalesce("match_percentage", F.lit(0))), F.desc("attendee_count"))


@rail("this-weekend", 3)
def this_weekend(events: DataFrame, context: dict) -> DataFrame:
    """Saturday 00:00 to Sunday 23:59:59 of this week; on a Sunday what is left of it."""
    today = F.to_date(context["now"])
    to_saturday = F.pmod(F.lit(7) - F.dayofweek(today), F.lit(7))
    sunday = F.dayofweek(today) == 1
    start = F.when(sunday, today).otherwise(F.date_add(today, to_saturday))
    end = F.when(sunday, F.date_add(today, 1)).otherwise(F.date_add(today, to_saturday + 2))
    return _top(events.filter((F.col("event_date") >= start.cast("timestamp")) & (F.col("event_date") < end.cast("timestamp"))), F.desc("attendee_count"), F.asc("event_date"))


@rail("location", 4)
def near_you(events: DataFrame, context: dict) -> DataFrame:
    """Coming events within half the radius, nearest first; those without a place come last."""
    half = (context.get("radius_km") or 25.0) / 2
    distance = geo.haversine_km(F.lit(context["lat"]), F.lit(context["lng"]), F.col("lat"), F.col("lng"))
    kept = events.filter(F.col("event_date") >= context["now"]).withColumn("_km", distance).filter(F.col("_km").isNull() | (F.col("_km") <= half))
    return _top(kept, F.asc(F.coalesce("_km", F.lit(999.0)))).drop("_km")


@rail("pulse", 5)
def pulse(events: DataFrame, context: dict) -> DataFrame:
    return _top(events.filter(F.col("event_date") >= context["now"]), F.desc("attendee_count"))


@rail("hidden-gems", 6)
def hidden_gems(events: DataFrame, context: dict) -> DataFrame:
    kept = events.filter((F.col("attendee_count") < 5) & F.col("image_url").isNotNull() & (F.col("event_date") > context["now"]))
    return _top(kept, F.desc(F.coalesce("match_percentage", F.lit(0))))


def all_rails(events: DataFrame, context: dict) -> DataFrame:
    """Every registered rail by priority: rail, rank, event_id. Each is a top ten of its own."""
    parts = []
    for name, (_, make) in sorted(RAILS.items(), key=lambda r: r[1][0]):
        kept = make(events, context)
        parts.append(kept.withColumn("_order", F.monotonically_increasing_id()).select(F.lit(name).alias("rail"), F.row_number().over(Window.orderBy("_order")).alias("rank"), "event_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def live(events: DataFrame, today: str, end_time: str, lat: float | None = None, lng: float | None = None, relevant: list[str] = (), blocked: DataFrame | None = None) -> DataFrame:
    """What goes on now: today's events that have begun by `end_time` or have no time, relevant ones first, then by distance.

    Blocked creators' events go; events without a creator stay.
    """
    no_time = F.col("event_time").isNull() | F.col("event_time").isin("", "TBD")
    kept = events.filter((F.date_format("event_date", "yyyy-MM-dd") == today) & (no_time | (F.col("event_time") <= end_time)))
    if blocked is not None:
        kept = kept.join(blocked.select(F.col("blocked_id").alias("created_by")), "created_by", "left_anti")
    distance = geo.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) if lat is not None and lng is not None else F.lit(None).cast("double")
    return kept.withColumn("distance_km", distance).withColumn("is_relevant", F.coalesce(F.col("category").isin(list(relevant)), F.lit(False)))


def daypart(hour: Column) -> Column:
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon").otherwise("evening")


def searched(events: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Events whose title, venue or category holds the query, in any case; of one category if it is given. A blank query holds anywhere."""
    found = events
    if query.strip():
        q = query.lower()
        found = found.filter(F.lower("title").contains(q) | F.coalesce(F.lower("venue_name").contains(q), F.lit(False)) | F.coalesce(F.lower("category").contains(q), F.lit(False)))
    return found.filter(F.lower("category") == category.lower()) if category else found

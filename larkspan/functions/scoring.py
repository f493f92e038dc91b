"""Scores as column expressions. Thresholds and weights are fixed values of the ranking rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"category": 0.35, "time": 0.20, "social": 0.15, "match": 0.10, "distance": 0.20}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def category_score(category: Column, preferred: list[str]) -> Column:
    if not preferred:
        return F.lit(0.5)
    return F.when(category.isin(preferred), 1.0).otherwise(0.3)


def time_score(days: Column) -> Column:
    return F.when(days < 0, 0.0).when(days < 1, 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-days / 7)))


def social_score(attendees: Column) -> Column:
    return F.when(attendees <= 0, 0.2).otherwise(clamp(F.log(attendees + 1.0) / F.log(F.lit(1000.0)), 0.2, 1.0))


def match_score(match: Column) -> Column:
    return F.coalesce(match, F.lit(50)) / 100.0


def distance_score(km: Column, radius_km: float) -> Column:
    radius = radius_km if radius_km > 0 else 25.0
    return F.when(km.isNull(), 0.5).when(km <= 0.1, 1.0).otherwise(clamp(1 / (1 + km / (radius * 0.5)), 0.1, 1.0))


def urgency_boost(hours: Column) -> Column:
    return F.when(hours < 0, 0.1).when(hours <= 6, 1.2).when(hours <= 24, 1.15).when(hours <= 72, 1.1).otherwise(1.0)


def trending_boost(attendees: Column) -> Column:
    return F.when(attendees >= 100, 1.2).when(attendees >= 50, 1.15).when(attendees >= 20, 1.1).when(attendees >= 10, 1.05).otherwise(1.0)


def mode_multiplier(category: Column, mode: str | None, is_parent: bool = False) -> Column:
    if mode == "family":
        out = F.when(category == "family", 2.5)
        if is_parent:
            out = out.when(category.isin("outdoors", "active"), 1.5)
        return out.otherwise(1.0)
    if mode == "social":
        return F.when(category.isin("social", "music", "foodie"), 2.0).when(category == "family", 0.3).otherwise(1.0)
    return F.lit(1.0)


def quality_penalty(image: Column, description: Column) -> Column:
    no_image = F.when(image.isNull() | (image == ""), 0.2).otherwise(1.0)
    thin = F.when(description.isNull() | (F.length(description) < 50), 0.8).otherwise(1.0)
    return no_image * thin


def base_score(parts: dict[str, Column]) -> Column:
    return sum((parts[name] * weight for name, weight in WEIGHTS.items()), F.lit(0.0))


def social_five_score(time: Column, venue: Column, address: Column, end_time: Column, minutes: Column, language: Column, interaction: Column) -> Column:
    """How many of five facts are known: time, place, duration, language, interaction."""
    facts = [
        time.isNotNull() & (time != "") & (time != "TBD"),
        (F.coalesce(venue, F.lit("")) != "") & (F.coalesce(address, F.lit("")) != ""),
        end_time.isNotNull() | (minutes > 0),
        language.isin("NL", "EN", "Mixed", "Other"),
        interaction.isin("high", "medium", "low", "passive"),
    ]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in facts), F.lit(0))


def social_five_strict(start: Column, venue: Column, street: Column, city: Column, end_time: Column, minutes: Column, language: Column, interaction: Column) -> Column:
    """The same where a start must be HH:MM, and a place is a venue with a street or a city."""
    facts = [
        start.rlike(r"^\d{2}:\d{2}$"),
        (F.coalesce(venue, F.lit("")) != "") & (F.coalesce(F.nullif(street, F.lit("")), city, F.lit("")) != ""),
        (F.coalesce(end_time, F.lit("")) != "") | F.coalesce(minutes > 0, F.lit(False)),
        language.isin("NL", "EN", "Mixed", "Other"),
        interaction.isin("high", "medium", "low", "passive"),
    ]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in facts), F.lit(0))


def missing_facts(**present: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in present.items()]))


def health_after(health: Column, failed: Column, complete: Column, has_image: Column, has_address: Column) -> Column:
    change = F.when(failed, -20).when(complete, 10).otherwise(2) - F.when(has_image, 0).otherwise(5) - F.when(has_address, 0).otherwise(5)
    return F.least(F.greatest(F.coalesce(health, F.lit(70)) + change, F.lit(0)), F.lit(100))


def enabled_after(enabled: Column, before: Column, after: Column) -> Column:
    return F.when(after < 40, False).when((before < 40) & (after >= 50), True).otherwise(enabled)


def source_priority(hours_since: Column, events: Column, failures: Column) -> Column:
    return (F.round(hours_since) + F.floor(events / 10) - failures * 20).cast("long")


def backoff_hours(failures: Column, level: Column) -> Column:
    """Hours to wait after three failures in a row, doubling with the level (5 at most) up to 32."""
    return F.when(failures >= 3, F.least(F.pow(F.lit(2.0), F.least(level, F.lit(5)) + 1), F.lit(32.0))).otherwise(0.0)


def breaker_cooldown_minutes(opens: Column) -> Column:
    return F.least(F.lit(30.0) * F.pow(F.lit(2.0), opens), F.lit(1440.0))


def retry_hours(retries: Column) -> Column:
    """Doubles with the count before this retry."""
    return F.pow(F.lit(2.0), retries)


def raised_rate_limit(limit_ms: Column, status: Column) -> Column:
    return F.when(status.isin(403, 429), F.least(limit_ms * 2, F.lit(30000))).otherwise(limit_ms)


def scrape_interval_minutes(volatility: Column) -> Column:
    return F.round(1440 - clamp(volatility, 0.0, 1.0) * (1440 - 15)).cast("int")


def reliability(attended: Column, committed: Column) -> Column:
    return F.when(committed == 0, 100.0).otherwise(clamp(attended * 100.0 / committed, 0.0, 100.0))


def decayed(reliability_score: Column) -> Column:
    return F.greatest(reliability_score - 0.05, F.lit(0.0))

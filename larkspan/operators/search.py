"""Semantic search: exact cosine similarity with a strict threshold, metadata and geography filters, top k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import geo, vectors


def vector_of(events: DataFrame, event_id: int, id_col: str = "event_id") -> list[float]:
    """The embedding of one event; raises if it has none. One row comes to the driver."""
    row = events.filter((F.col(id_col) == event_id) & F.col("embedding").isNotNull()).select("embedding").first()
    if row is None:
        raise ValueError(f"event {event_id} has no embedding")
    return [float(x) for x in row[0]]


def match(events: DataFrame, query: list[float], threshold: float = 0.7, limit: int = 10, category: str | None = None) -> DataFrame:
    """The events most similar to a vector: similarity strictly above the threshold, ties by id."""
    kept = events.filter(F.col("embedding").isNotNull())
    if category is not None:
        kept = kept.filter(F.col("category") == category)
    return kept.withColumn("similarity", vectors.cosine_to(F.col("embedding"), query)).filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "event_id").limit(limit)


def find_similar(events: DataFrame, event_id: int, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    return match(events.filter(F.col("event_id") != event_id), vector_of(events, event_id), threshold, limit)


def by_vibe(events: DataFrame, query: list[float], lat: float | None = None, lng: float | None = None, radius_km: float = 25.0, threshold: float = 0.6, limit: int = 20) -> DataFrame:
    """`match` within a radius; the box filter comes before any vector is read in full."""
    distance = F.lit(None).cast("double")
    if lat is not None and lng is not None:
        distance = geo.haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
        events = events.filter(geo.within_box(F.col("lat"), F.col("lng"), lat, lng, radius_km)).filter(distance <= radius_km)
    return match(events.withColumn("distance_km", distance), query, threshold, limit)

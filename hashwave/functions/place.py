"""Points of a post, as (lat, lng) column pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: west, south, east, north of the box the live feed covers.
WORLD_BOX = (-179.9, -89.9, 179.9, 89.9)


def _lat_lng(lng_lat: Column) -> tuple[Column, Column]:
    return F.get(lng_lat, F.lit(1)), F.get(lng_lat, F.lit(0))


def place_point(place: Column) -> tuple[Column, Column]:
    """First corner of the place's bounding box."""
    rings = place.getField("bounding_box").getField("coordinates")
    return _lat_lng(F.get(F.get(rings, F.lit(0)), F.lit(0)))


def resolve_point(coordinates: Column, place: Column) -> tuple[Column, Column]:
    """The exact point where the post has one, else the corner of its place, else NULLs."""
    exact = _lat_lng(coordinates.getField("coordinates"))
    corner = place_point(place)
    lat, lng = (
        F.when(coordinates.isNotNull(), at).otherwise(fallback)
        for at, fallback in zip(exact, corner)
    )
    return lat, lng


def in_box(lat: Column, lng: Column, west: float, south: float, east: float, north: float) -> Column:
    return lng.between(F.lit(float(west)), F.lit(float(east))) & lat.between(
        F.lit(float(south)), F.lit(float(north))
    )

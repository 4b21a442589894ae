"""Labels, colours and display values of listings, matches and parcels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A listing's status as the community submits it; labels and colours of matches; colours of markers.
COMMUNITY = ("no_license_at_address", "license_at_address", "undetermined")
MATCH_LABELS = {
    "license_number": "License number",
    "owner_name": "Full owner / host name",
    "owner_first_name": "Owner / host first name",
    "owner_nickname": "Owner / host nickname",
    "permit_owner_name": "Full permit owner / host name",
    "permit_owner_first_name": "Permit owner / host first name",
    "permit_owner_nickname": "Permit owner / host nickname",
    "distance": "Distance only",
}
MATCH_COLORS = {"license_number": "#166534", "distance": "#475569", "nickname": "#7e22ce", "first_name": "#a16207", "name": "#1d4ed8"}
MARKER_COLORS = {"hotel": "#f97316", "expired": "#facc15", "current": "#22c55e", "over": "#fb7185", "other": "#c4b5fd", "none": "#e2e8f0"}
STROKES = {"over": "#dc2626", "plain": "#2563eb"}
PARCEL_BADGES = {"current": "Current permit on parcel", "historical": "expired permit", "none": "No current permit record on parcel"}
FALLBACK_RADIUS_M = 15.0


def community_status(status: Column) -> Column:
    return F.when(status.isin(*COMMUNITY), status).otherwise("undetermined")


def marker_kind(hotel: Column, status: Column, over: Column) -> Column:
    """The first that holds of hotel, expired, current, over (capacity) and other; else none."""
    out = F.when(hotel, "hotel").when(status.isin("expired", "current"), status)
    return out.when(over, "over").when(status == "other", "other").otherwise("none")


def _of(kind: Column, table: dict[str, str], default: Column | None = None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(kind == k, v)
    return out if default is None else out.otherwise(default)


def marker_color(hotel: Column, status: Column, over: Column) -> Column:
    return _of(marker_kind(hotel, status, over), MARKER_COLORS)


def marker_stroke(over: Column) -> Column:
    return F.when(over, STROKES["over"]).otherwise(STROKES["plain"])


def marker_label(guests: Column, overage: Column, over: Column) -> Column:
    """Guests, ? if unknown; a second line says by how many they are over."""
    whole = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.coalesce(whole(guests), F.lit("?")), F.when(over, F.concat(F.lit("\n+"), whole(overage))).otherwise(""))


def match_label(kind: Column) -> Column:
    return _of(kind, MATCH_LABELS, kind)


def match_color(kind: Column) -> Column:
    """By category: licence number, distance, nickname, first name, full name."""
    out = F.when(kind.isin("license_number", "distance"), _of(kind, MATCH_COLORS))
    for k in ("nickname", "first_name"):
        out = out.when(F.contains(kind, F.lit(k)), MATCH_COLORS[k])
    return out.otherwise(MATCH_COLORS["name"])


def parcel_badge(current: Column, historical: Column) -> Column:
    return F.when(current, PARCEL_BADGES["current"]).when(historical, PARCEL_BADGES["historical"]).otherwise(PARCEL_BADGES["none"])


def permit_values(permits: Column, fields: tuple[str, ...] = ("permit_number", "permit", "id", "number")) -> Column:
    """The first field of each permit that is not null, trimmed; blank ones go. permits: array of maps; null gives none."""
    values = F.transform(permits, lambda p: F.trim(F.coalesce(*(F.try_element_at(p, F.lit(f)) for f in fields), F.lit(""))))
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def ring_radius(radius: Column, selected: Column) -> Column:
    """Radius of a privacy ring: a positive one; for the selected listing a small one instead of none."""
    return F.when(radius > 0, radius).when(selected, FALLBACK_RADIUS_M)


def status_label(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def first_of(m: Column, *keys: str) -> Column:
    """The first key of a map that has a value: aliases of one field."""
    return F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))


def without_blanks(m: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(m, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))

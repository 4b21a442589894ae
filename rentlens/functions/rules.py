"""Screening rules: capacity, permit and listing status, overlap of circles and parcels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules.
MOST_GUESTS, MOST_GUESTS_TWO = 12, 24
LEEWAY_PERCENT, TOLERANCE_M, SLACK = 10.0, 9.144, 1e-6
LARGE_BEDROOMS, FEE = 5, 313
PARCEL_ORDER = ("current", "revoked", "suspended", "expired")
LISTING_ORDER = ("current", "expired")


def capacity(bedrooms: Column, licenses: Column | None = None) -> Column:
    """Guests allowed: two a bedroom and four, twelve at most; null if bedrooms are unknown or negative.

    With exactly two licences: two a bedroom and eight, twenty-four at most.
    """
    one = F.when(bedrooms >= 0, F.least(2 * bedrooms + 4, F.lit(float(MOST_GUESTS))))
    if licenses is None:
        return one
    return F.when(licenses == 2, F.when(bedrooms >= 0, F.least(2 * bedrooms + 8, F.lit(float(MOST_GUESTS_TWO))))).otherwise(one)


def overage(bedrooms: Column, guests: Column, licenses: Column | None = None) -> Column:
    """Guests over what capacity() allows; null if guests are unknown.

    With unknown bedrooms only guests over the most that any home may have count; fewer are unknown, not 0.
    """
    allowed = capacity(bedrooms, licenses)
    most = F.lit(float(MOST_GUESTS)) if licenses is None else F.when(licenses == 2, float(MOST_GUESTS_TWO)).otherwise(float(MOST_GUESTS))
    return F.when(allowed.isNotNull(), F.when(guests.isNotNull(), F.greatest(F.lit(0.0), guests - allowed))).when(guests > most, guests - most)


def over_occupancy(hotel: Column, bedrooms: Column, licenses: Column, over: Column, exclude_large: bool = True, exclude_multiple: bool = True) -> Column:
    """Whether a listing counts as over capacity: no hotel, by choice not large nor of several licences, over by one or more."""
    out = ~F.coalesce(hotel, F.lit(False)) & F.coalesce(over >= 1, F.lit(False))
    if exclude_large:
        out = out & ~F.coalesce(bedrooms > LARGE_BEDROOMS, F.lit(False))
    return out & ~F.coalesce(licenses > 1, F.lit(False)) if exclude_multiple else out


def permit_status(status: Column, expiry: Column, as_of: Column) -> Column:
    """expired, current (also on the day of expiry), another status in lower case, or unknown."""
    s = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    issued = F.when(expiry < as_of, "expired").otherwise("current")
    return F.when(s == "EXPIRED", "expired").when(s == "ISSUED", issued).otherwise(F.coalesce(F.nullif(F.lower(s), F.lit("")), F.lit("unknown")))


def listing_status(statuses: Column, numbers: Column) -> Column:
    """current > expired > other; unmatched with numbers only, unknown without."""
    out = F.when(F.array_contains(statuses, "current"), "current").when(F.array_contains(statuses, "expired"), "expired")
    return out.when(F.size(statuses) > 0, "other").when(F.size(numbers) > 0, "unmatched").otherwise("unknown")


def rank_of(status: Column, order: tuple[str, ...] = PARCEL_ORDER) -> Column:
    """Place of a status in an order; null if it has none."""
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(order))):
        out = F.when(status == s, F.lit(i)).otherwise(out)
    return out


def circle_overlaps(distance: Column, radius: Column, leeway: float = LEEWAY_PERCENT, tolerance: float = TOLERANCE_M) -> Column:
    """Whether a circle reaches a parcel; null if either is unknown. The leeway stretches the radius only."""
    return distance <= radius * (1 + leeway / 100) + tolerance + SLACK


def in_scope(edge_distance: Column, buffer: float = 0.0) -> Column:
    """Signed distance to the edge, positive inside, is no less than minus the buffer."""
    return F.coalesce(edge_distance >= -F.lit(buffer), F.lit(False))


def likely_unlicensed(hotel: Column, scope: Column, overlap: Column) -> Column:
    """Unknown overlap never counts."""
    return F.coalesce(~F.coalesce(hotel, F.lit(False)) & scope & ~overlap, F.lit(False))


def license_count(detected: Column, numbers: Column) -> Column:
    return F.greatest(F.coalesce(detected, F.lit(0)), F.coalesce(F.size(F.array_distinct(numbers)), F.lit(0)))


def auto_match_status(hotel: Column, licensed: Column, unlicensed: Column, near: Column) -> Column:
    """hotel; licensed, if the parcels of all matches by name have a current permit; nearby; unlicensed, if none has; unknown."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(yes(hotel), "hotel").when(yes(licensed) & ~yes(unlicensed), "licensed").when(yes(near), "nearby")
    return out.when(yes(unlicensed) & ~yes(licensed), "unlicensed").otherwise("unknown")


def distance_band(m: Column) -> Column:
    return F.when(m <= 1000, "within_1km").when(m.isNotNull(), "1km_to_1.1km_buffer")


def percent(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.nullif(whole, F.lit(0))


def stale(checked_at: Column, now: Column, seconds: int = 120) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(checked_at)) > seconds

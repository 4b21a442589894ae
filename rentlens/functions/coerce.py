"""Coercions and keys as column expressions; unknown is null, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[ \t]*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"


def blank(c: Column) -> Column:
    """Null for null, white space and the words none, null and nan."""
    return F.when(~F.lower(F.trim(c)).isin("", "none", "null", "nan"), c)


def number(c: Column) -> Column:
    """A finite double, else null."""
    x = F.when(c.cast("string").rlike(NUMERIC), F.replace(c.cast("string"), F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def point(lon: Column, lat: Column) -> Column:
    """struct(lon, lat) within range; null outside it, and where both are 0."""
    lon, lat = number(lon), number(lat)
    good = lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat")))


def listing_id(url: Column, id_: Column) -> Column:
    """Digits of /rooms/<digits> in the url, else an id of digits only. Ids stay strings: they exceed doubles."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/rooms/(\d+)", 1), F.lit("")), F.when(F.trim(id_).rlike(r"^\d+$"), F.trim(id_)))


def permit_key(c: Column) -> Column:
    """The ten digits of a whole permit identifier, '' for anything else."""
    return F.regexp_extract(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s#_-]", "")), r"^(?:CASR|STRP?|T)?(20\d{8})$", 1)


def parse_date(c: Column) -> Column:
    """A date in month/day/year or ISO form, from the text before the first space."""
    head = F.split(F.trim(c), " ")[0]
    return F.coalesce(F.try_to_date(head, "M/d/yyyy"), F.try_to_date(head, "yyyy-MM-dd"))


def squeeze_upper(c: Column) -> Column:
    """White space collapsed to single spaces, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def pin(c: Column) -> Column:
    """A parcel number without white space, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def parcel_key(c: Column) -> Column:
    """A parcel number of letters and digits only, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]", ""))


def host_key(user_id: Column, profile_url: Column, name: Column) -> Column:
    """The host's user id, else the profile address, else the name."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    return F.coalesce(filled(user_id), F.lower(filled(profile_url)), F.concat(F.lit("name:"), F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("(unknown)"))))


def url_key(url: Column) -> Column:
    """Host without www. and a room's id, or the path without its last slashes."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    room = F.regexp_extract(path, r"/rooms/(?:plus/)?(\d+)", 1)
    return F.when(room != "", F.concat(host, F.lit(":"), room)).otherwise(F.concat(host, path))


def combo_key(m: Column, shown: tuple[str, ...] | None = None) -> Column:
    """Sorted keys of a map, joined; of those in ``shown``, if given."""
    keys = F.map_keys(m) if shown is None else F.array_intersect(F.map_keys(m), F.array(*map(F.lit, shown)))
    return F.coalesce(F.array_join(F.array_sort(keys), "|"), F.lit(""))


def record_text(*names: str) -> Column:
    """All columns of a row as one lower-case text to search in."""
    return F.lower(F.to_json(F.struct(*(names or ("*",)))))


def text_of_keys(m: Column, words: tuple[str, ...], keyed: bool = False) -> Column:
    """Values of the map entries whose key holds one of the words, one a line, in the order of the keys; with ``key: ``."""
    kept = F.map_filter(m, lambda k, _: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(k), w)))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws(": ", e.key, e.value) if keyed else e.value), "\n")


def before_marker(text: Column, marker: str = "=== HOST DETAILS ===") -> Column:
    return F.substring_index(text, marker, 1)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def form_url(base: Column, entries: dict[str, Column]) -> Column:
    """A prefilled form's address; names other than entry.<digits> and other hosts give null."""
    import re

    if bad := [k for k in entries if not re.fullmatch(r"entry\.\d+", k)]:
        raise ValueError(f"not a form entry: {bad}")
    query = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v.cast("string"), F.lit("")))) for k, v in entries.items()))
    return F.when(base.rlike(r"^https://docs\.google\.com/forms/"), F.concat(base, F.lit("?usp=pp_url&"), query))


def audit(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)

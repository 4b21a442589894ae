"""Hotel classifier: a cascade of rules over a listing's fields, in a stated order of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import before_marker
from .text import first_hit, let, nfkc, place_of

#: Hotel brands, and local hotels by name; both can be replaced.
BRANDS = (
    "wyndham|marriott|hilton|hyatt|sheraton|westin|doubletree|hampton inn|homewood suites|home2 suites|embassy suites|holiday inn|staybridge suites|candlewood suites|residence inn|"
    "springhill suites|towneplace suites|fairfield inn|la\\s*quinta|best western|comfort inn|comfort suites|quality inn|sleep inn|days inn|super 8|red roof inn|extended stay america|"
    "drury|moxy|aloft|kimpton|loews|margaritaville|gaylord opryland|bluegreen|placemakr|mint house|sonder|ac hotel|cambria hotel|omni nashville|conrad nashville|four seasons|renaissance nashville|w nashville"
)
LOCAL = (
    "hermitage hotel|bobby hotel|the nash hotel|fairlane hotel|noelle nashville|dream nashville|holston house|hutton hotel|hotel fraye|hayes street hotel|capitol hotel|bankers alley hotel|"
    "countrypolitan|thompson nashville|virgin hotels?|graduate nashville|aertson hotel|maxwell house hotel|studio 154|bode nashville|the joseph|union station hotel|union station nashville|"
    "printing house hotel|songteller hotel|motif on music row|the russell hotel|the gallatin hotel|the iris motel|the dive motel|the gilmore|the outrider|the carter|the nomad"
)
#: Words for a hotel, words that make a mention a comparison or a neighbour, words that make it the place itself.
GENERIC = r"\b(?:hotels?|aparthotel|apart-hotel|boutique hotel|motel|resort)\b"
ELSEWHERE = (
    r"\b(?:near(?:by)?|close to|next to|across from|from|away|walk to|minutes? to|miles? to|visit|unlike|better than|instead of|not (?:a|an)|(?:hotel|resort)[- ](?:style|quality|vibes|like)|similar to|"
    r"your dream|comforts of home|elevation of a hotel|expecting|hotel room experience|like a hotel|conference|day.pass|limozeen|florida|resort[- ](?:pool|amenities|living|vibes)|horse hotel|heartbreak hotel)\b"
)
ITSELF = (
    r"\b(?:welcome to|stay at|staying at|located (?:at|in)|our (?:(?:boutique|luxury|apartment) )?(?:hotel|resort|property)|this (?:hotel|resort)|hotel (?:room|guest)|resort (?:offers|features)|"
    r"(?:this property|this building|we) (?:is|are) (?:a|an) .{0,25}(?:hotel|resort)|managed by|operated by)\b"
)
TINY, ROOM, INN = r"\btiny[\s_-]*(?:home|house)s?\b", r"\bhotel[ _-]*room\b|\broom in (?:a |boutique )?hotel\b", r"\binn\b"
TYPES = ("rental_type", "property_type", "room_type", "accommodation_type")
IDENTITY = ("title", "name", "host_name")
BEFORE, AFTER, EVIDENCE, MENTION_BEFORE, MENTION_AFTER = 65, 30, 450, 80, 120
INN_SAYS = "Inn mentioned in listing; default hotel classification. "
OVERRIDE_SAYS = "User override: AvantStay Nashville + SoBro. "


def _any(fields: dict[str, Column], names, pattern: str) -> Column:
    have = [F.coalesce(fields[n].rlike(f"(?iuU)(?:{pattern})"), F.lit(False)) for n in names if n in fields]
    return reduce(lambda a, b: a | b, have, F.lit(False))


def explicit_room(fields: dict[str, Column]) -> Column:
    """A type field says hotel room."""
    return _any(fields, TYPES, ROOM)


def _windowed(text: Column, pattern: str, said: str) -> Column:
    """What a rule says and a field around the first hit; null without one."""
    return F.concat(F.lit(said), first_hit(text, pattern, MENTION_BEFORE, MENTION_AFTER))


def _sentence(text: Column, kind: str, named: str) -> Column:
    """The first sentence of a field that says the place is a hotel; kind: type, identity or narrative."""

    def says(s: Column) -> Column:
        # Most sentences have neither a name nor a word, which one look tells. A name goes before a generic word, wherever it stands.
        return s.rlike(f"(?iuU)(?:{named}|{GENERIC})") & let(F.coalesce(place_of(s, named), place_of(s, GENERIC)), lambda at: about(s, at))

    def about(s: Column, at: Column) -> Column:
        size = F.char_length(_hit(s, named))
        start = F.greatest(at - BEFORE, F.lit(0))
        around = F.substring(s, start + 1, at - start + size + AFTER)
        good = at.isNotNull()
        if kind != "type":
            good = good & ~around.rlike(f"(?iuU){ELSEWHERE}")
        return good & s.rlike(f"(?iuU){ITSELF}") if kind == "narrative" else good

    return F.get(F.filter(F.split(text, r"[\n.!?;]+"), says), F.lit(0))


def _hit(text: Column, named: str) -> Column:
    """A hotel's name, else a generic word; '' without either."""
    name = F.nullif(F.regexp_extract(text, f"(?iuU)(?:{named})", 0), F.lit(""))
    return F.coalesce(name, F.regexp_extract(text, f"(?iuU)(?:{GENERIC})", 0))


def _found(field: str, match: Column, rule: str, evidence: Column) -> Column:
    """One piece of evidence: field, match, rule and evidence; its evidence is null where there is none."""
    return F.struct(F.lit(field).alias("field"), F.nullif(match, F.lit("")).alias("match"), F.lit(rule).alias("rule"), evidence.alias("evidence"))


def classify(fields: dict[str, Column], reported: Column, not_hotel: Column, brands: str = BRANDS, local: str = LOCAL, override: tuple[str, str] = ("avantstay nashville", "sobro")) -> Column:
    """struct(likely_hotel, rule, evidence, hits) of a listing; ``fields`` are its texts in the order they are read.

    In turn: a tiny home is none; a tip that it is none holds, unless a type says hotel room; a report holds; ``inn``
    in a field; a host (override) that mentions a place; a hotel's name or word in a sentence that is about the place.
    hits has all evidence of the last three with its field and match: one of the first two each, one a field of the
    last. What follows the marker of the host's details counts for the last only; where a place is (location_name) not
    for that one. Fields are brought to NFKC here.
    """
    named = rf"\b(?:{brands}|{local})\b"
    fields = {k: nfkc(v) for k, v in fields.items()}
    own = {k: before_marker(v) for k, v in fields.items() if k not in ("host_name", "host_details")}
    host = F.lower(F.trim(F.regexp_replace(fields["host_name"], r"\s+", " "))) if "host_name" in fields else F.lit(None).cast("string")
    first = lambda hits: F.slice(F.filter(F.array(*hits), lambda h: h.evidence.isNotNull()), 1, 1)
    inn = first(_found(k, F.regexp_extract(v, f"(?iuU){INN}", 0), "inn_default", _windowed(v, INN, INN_SAYS)) for k, v in own.items())
    place = first(_found(k, F.regexp_extract(v, rf"(?iuU)\b{override[1]}\b", 0), "host_override", F.when(host == override[0], _windowed(v, rf"\b{override[1]}\b", OVERRIDE_SAYS))) for k, v in own.items())
    kinds = {k: "type" if k in TYPES else "identity" if k in IDENTITY else "narrative" for k in fields if k != "location_name"}
    sentences = {k: _sentence(fields[k], kind, named) for k, kind in kinds.items()}
    said = F.filter(F.array(*(let(v, lambda v, k=k: _found(k, _hit(v, named), "hotel_words", F.substring(F.trim(v), 1, EVIDENCE))) for k, v in sentences.items())), lambda h: h.evidence.isNotNull())
    hits = F.concat(inn, place, said)
    none = F.array().cast("array<struct<field:string,match:string,rule:string,evidence:string>>")
    made = lambda hotel, rule, evidence, hits: F.struct(F.lit(hotel).alias("likely_hotel"), rule.alias("rule"), evidence.cast("string").alias("evidence"), hits.alias("hits"))
    no = F.lit(None)
    return (
        F.when(_any(fields, (*TYPES, "title", "name"), TINY), made(False, F.lit("tiny_home"), no, none))
        .when(F.coalesce(not_hotel, F.lit(False)) & ~explicit_room(fields), made(False, F.lit("user_submitted_not_hotel"), no, none))
        .when(F.coalesce(reported, F.lit(False)), made(True, F.lit("hotel_submission"), no, none))
        .otherwise(let(hits, lambda h: F.when(F.size(h) > 0, made(True, h[0]["rule"], h[0]["evidence"], h)).otherwise(made(False, F.lit("none"), no, none))))
    )

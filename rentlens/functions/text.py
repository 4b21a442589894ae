"""Extraction from free text. Patterns are Java's; (?iuU) makes their classes and case Unicode."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords by amenity.
AMENITIES = {
    "pool": r"\bpool\b(?!\s+table)",
    "hot_tub": r"\b(?:hot\s*tub|jacuzzi)\b",
    "bar": r"\bbar\b",
    "pool_table": r"\bpool\s+table\b",
    "karaoke": r"karaoke",
    "dance_pole": r"\b(?:dance|dancing|stripper|strip)\s+pole\b|\bpole\s+dancing\b",
    "bachelor_party": r"\bbachelor(?:\s+(?:party|weekend|trip))?\b",
    "bachelorette_party": r"\bbachelorette(?:\s+(?:party|weekend|trip))?\b",
}
#: Permit numbers, the words that have to be near one, and licence numbers in lines.
EXACT = r"(?<!\d)(?:CASR[\s:#_-]*|STRP?[\s:#_-]*|T)?20\d{8}(?!\d)"
FORMATTED = r"\b20\d{2}(?:[\s_:#-]|followed\s*by|fol+owed\s*by){1,35}\d{1,6}(?:(?:[\s_:#-]|followed\s*by|fol+owed\s*by){1,35}\d{1,3})?"
PERMIT_WORDS = r"permit|licen[sc]e|registration|\bCASR\b|\bSTR\b"
LINE_PREFIX = r"\b(svr|str|stvr|oic|otc|license|certificate)\b"
LINE_NUMBER = r"\b([A-Z]{2,4}-\d{4,6}|\d{5,6}|STR-\d{6}-\d{4}|STR\d{4}-\d{5}|STR\d{4}-\d{4})\b"
WINDOW_BEFORE, WINDOW_AFTER, PERMIT_WINDOW, HEADER_LINES = 55, 80, 100, 6
RULE = "----------------------------------------"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC without format characters; ASCII passes as it is."""
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf"))


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; ASCII passes as it is."""
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def place_of(text: Column, pattern: str) -> Column:
    """Code points before a pattern's first hit, as substring() counts them; null without one."""
    p = f"(?iuU)(?:{pattern})"
    return F.when(text.rlike(p), F.char_length(F.split(text, p, 2)[0]))


def first_hit(text: Column, pattern: str, before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER) -> Column:
    """The first hit of a pattern with some characters around it, trimmed; null without one."""
    at = place_of(text, pattern)
    start = F.greatest(at - before, F.lit(0))
    hit = F.char_length(F.regexp_extract(text, f"(?iuU)(?:{pattern})", 0))
    return F.trim(F.substring(text, start + 1, at - start + hit + after))


def amenities(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Map of amenity to the evidence of its first hit."""
    patterns = AMENITIES if patterns is None else patterns
    entries = F.array(*(F.struct(F.lit(k).alias("key"), first_hit(text, p).alias("value")) for k, p in patterns.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))


def hits(text: Column, pattern: str) -> Column:
    """Array of struct(raw, at): every hit of a pattern, and the code points before it. A hit has a character at least."""
    p = f"(?iuU)(?:{pattern})"
    raw, gaps = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
    sized = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda total, x: total + F.char_length(x))
    return F.transform(raw, lambda r, i: F.struct(r.alias("raw"), (sized(gaps, i + 1) + sized(raw, i)).alias("at")))


def trimmed(text: Column) -> Column:
    """Without white space at its ends, whatever its kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _numbers(text: Column, pattern: str, method: str) -> Column:
    """Hits of a pattern as struct(number, raw, method, evidence)."""
    digits = lambda h: F.regexp_replace(h.raw, r"(?U)\D", "")
    whole = lambda d: F.concat(F.substring(d, 1, 4), F.lpad(F.substring(d, 5, 6), 6, "0"))
    number = lambda d: F.when(F.char_length(d).between(5, 10), whole(d)).otherwise(d) if method == "formatted" else d
    start = lambda h: F.greatest(h["at"] - PERMIT_WINDOW, F.lit(0))
    around = lambda h: trimmed(text.substr(start(h) + 1, h["at"] - start(h) + F.char_length(h.raw) + PERMIT_WINDOW))
    return F.transform(hits(text, pattern), lambda h: F.struct(number(digits(h)).alias("number"), h.raw.alias("raw"), F.lit(method).alias("method"), around(h).alias("evidence")))


def permits(text: Column) -> Column:
    """Array of struct(number, raw, method, evidence): permit numbers of a text, exact ones first, each number once.

    A number is 20 and eight digits; year and serial stand for ten digits together. Its evidence is PERMIT_WINDOW
    characters on either side, and has to hold a permit word. A null text has none.
    """

    def good(t: Column) -> Column:
        found = F.concat(_numbers(t, EXACT, "exact"), _numbers(t, FORMATTED, "formatted"))
        return F.filter(found, lambda n: n.number.rlike(r"(?U)^20\d{8}$") & n.evidence.rlike(f"(?iuU){PERMIT_WORDS}"))

    once = lambda known: F.filter(known, lambda n, i: F.array_position(F.transform(known, lambda m: m.number), n.number) == i + 1)
    # Each step is named by an array of one, so that it is evaluated once, and may come from Python.
    return F.transform(F.transform(F.array(F.coalesce(text, F.lit(""))), good), once)[0]


def room_ids(text: Column) -> Column:
    """Ids in /rooms/<digits>, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"/rooms/(?:plus/)?(\d+)"), 1))


def header(text: Column) -> Column:
    """Map of the ``key: value`` lines before the dashed rule; keys in lower case with _ for spaces; the last wins."""
    lines = F.filter(F.split(F.split(text, "\n-{5,}")[0], "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.replace(F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_")).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p.k == k), lambda p: p.v), -1)))


def occupancy(text: Column) -> Column:
    """struct(guests, bedrooms) of a ``N guests · M bedrooms`` header; null without one."""
    p = r"(?iuU)(?<!\d)(\d+)\+?\s+guests?\s*[·•|]\s*(\d+)\s+bedrooms?\b"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("int").alias("guests"), F.regexp_extract(text, p, 2).cast("int").alias("bedrooms")))


def word_context(text: Column, hit: Column, words: int = 5) -> Column:
    """struct(before, after): up to ``words`` words on either side of the first word that holds ``hit``."""
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(split, lambda w: F.contains(w, hit)), True).cast("int")
    before = F.slice(split, F.greatest(at - words, F.lit(1)), F.least(F.lit(words), F.greatest(at - 1, F.lit(0))))
    return F.when(at > 0, F.struct(F.array_join(before, " ").alias("before"), F.array_join(F.slice(split, at + 1, F.lit(words)), " ").alias("after")))


def body_lines(files: DataFrame, file: str = "file", text: str = "text", skip: int = HEADER_LINES) -> DataFrame:
    """(file, line_number, line) after the first lines and before the dashed rule; numbers from 1."""
    lines = files.select(file, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.col("n") >= skip)
    past = F.max(F.contains("line", F.lit(RULE))).over(Window.partitionBy(file).orderBy("n"))
    return lines.withColumn("__past", past).where("not __past").select(file, (F.col("n") + 1).alias("line_number"), F.trim("line").alias("line"))


def license_lines(lines: DataFrame, file: str = "file") -> DataFrame:
    """Licence numbers in a line and the next, with the prefix that suits each best; a number once a line.

    A prefix that the number starts with wins over the first prefix; a number without any prefix stands alone, and
    counts only the line's own context.
    """
    following = F.coalesce(F.lead("line").over(Window.partitionBy(file).orderBy("line_number")), F.lit(""))
    rows = lines.withColumn("both", F.concat_ws(" ", "line", following))
    rows = rows.withColumns({"prefixes": F.regexp_extract_all("both", F.lit(f"(?iu){LINE_PREFIX}"), 1), "numbers": F.array_distinct(F.regexp_extract_all("both", F.lit(f"(?iu){LINE_NUMBER}"), 1))})
    rows = rows.withColumn("number", F.explode("numbers"))
    own = F.filter("prefixes", lambda p: F.startswith(F.upper("number"), F.upper(p)))
    best = F.upper(F.coalesce(F.get(own, F.lit(0)), F.get("prefixes", F.lit(0)), F.lit("")))
    rows = rows.withColumn("prefix", best).withColumn("context", word_context(F.when(F.col("prefix") == "", F.col("line")).otherwise(F.col("both")), F.col("number")))
    kind = F.when(F.col("prefix") == "", "number_only").otherwise("prefix_number")
    return rows.select(file, "line_number", kind.alias("match_type"), "prefix", "number", F.trim(F.concat_ws(" ", "prefix", "number")).alias("match"), F.coalesce("context.before", F.lit("")).alias("before"), F.coalesce("context.after", F.lit("")).alias("after"))

"""Queries on texts, names and nicknames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, coerce, hotels, names, text
from ..operators import hosts, nicknames
from .registry import query, table

#: Invented nicknames for words of part names.
NICKNAMES = (("small", "has_nickname", "tiny"), ("red", "has_nickname", "ruby"), ("ring", "has_nickname", "hoop"), ("ring", "has_nickname", "band"), ("blue", "has_nickname", "ruby"), ("widget", "has_nickname", "gizmo"))
_VALUES = ", ".join(f"('{a}', '{b}')" for a, _, b in NICKNAMES)


def _edges(spark):
    return spark.createDataFrame(list(NICKNAMES), "name1 string, relationship string, name2 string")


_LEAD = "\U0001f3e0" * 30  #: characters of two UTF-16 units, before every text


@query(rf"""SELECT doc_id, strpos(lower(text), 'license') > 0 AS hit,
  CASE WHEN strpos(lower(text), 'license') > 0 THEN trim(substr(text, greatest(strpos(lower(text), 'license') - 55, 1),
    strpos(lower(text), 'license') - greatest(strpos(lower(text), 'license') - 55, 1) + 7 + 80)) END AS evidence FROM (SELECT doc_id, '{_LEAD}' || text AS text FROM documents)""")
def keyword_first_hit_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.first_hit(F.concat(F.lit(_LEAD), "text"), "license").alias("evidence"))
    return d.select("doc_id", F.col("evidence").isNotNull().alias("hit"), "evidence")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)license')) AS hits, regexp_matches(text, '(?i)licensed under') AS under FROM documents""")
def keyword_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("(?i)license")).cast("long").alias("hits"), F.col("text").rlike("(?i)licensed under").alias("under"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Permit 20' || lpad(CAST(doc_id AS VARCHAR), 8, '0') WHEN 1 THEN 'permit 2021-' || doc_id || ' issued'
    WHEN 2 THEN 'call 20' || lpad(CAST(doc_id AS VARCHAR), 8, '0') ELSE 'license T20' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '7' END AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_extract(s, '(^|[^0-9])(20[0-9]{8})($|[^0-9])', 2) ELSE '2021' || lpad(regexp_extract(s, '2021-([0-9]+)', 1), 6, '0') END AS number,
  CASE doc_id % 4 WHEN 0 THEN 'exact' ELSE 'formatted' END AS method FROM t WHERE doc_id % 4 < 2""")
def permit_number_extract(spark, sf_dir):
    i = F.col("doc_id")
    eight = F.lpad(i.cast("string"), 8, "0")
    s = F.when(i % 4 == 0, F.concat(F.lit("Permit 20"), eight)).when(i % 4 == 1, F.concat(F.lit("permit 2021-"), i, F.lit(" issued"))).when(i % 4 == 2, F.concat(F.lit("call 20"), eight)).otherwise(F.concat(F.lit("license T20"), eight, F.lit("7")))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.permits(F.concat(s, F.lit("\n" + " " * 120), "text"))).alias("p"))
    return found.select("doc_id", "p.number", "p.method")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')
  || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS url_key,
  CASE WHEN regexp_matches('https://x.example/rooms/' || page_id, '/rooms/[0-9]+') THEN CAST(page_id AS VARCHAR) END AS listing_id FROM pages""")
def url_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    made = F.concat(F.lit("https://x.example/rooms/"), "page_id", F.lit("?a=1"))
    return p.select("page_id", coerce.url_key(F.col("url")).alias("url_key"), coerce.listing_id(made, F.lit(None).cast("string")).alias("listing_id"))


@query(r"""WITH d AS (SELECT doc_id, repeat(chr(10), 6) || 'License ' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || chr(10) || 'see STR-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-2024 or 5551234567'
  || chr(10) || text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '----------------------------------------' || chr(10) || 'OTC-12345' ELSE chr(10) || 'OTC-12345' END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
r AS (SELECT doc_id, min(n) AS n FROM l WHERE contains(line, '----------------------------------------') GROUP BY doc_id),
b AS (SELECT doc_id, l.n AS line_number, trim(line) || ' ' || coalesce(trim(lead(line) OVER (PARTITION BY doc_id ORDER BY l.n)), '') AS pair FROM l LEFT JOIN r USING (doc_id) WHERE l.n > 6 AND l.n < coalesce(r.n, 1000000000))
SELECT DISTINCT doc_id, line_number, unnest(regexp_extract_all(pair, '(?i)\b([A-Z]{2,4}-\d{4,6}|\d{5,6}|STR-\d{6}-\d{4}|STR\d{4}-\d{5}|STR\d{4}-\d{4})\b', 1)) AS number FROM b""")
def line_scan_lookahead(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    top = F.concat(F.lit("\n" * 6 + "License "), F.lpad(i, 5, "0"), F.lit("\nsee STR-"), F.lpad(i, 6, "0"), F.lit("-2024 or 5551234567\n"))
    end = F.when(F.col("doc_id") % 2 == 0, F.lit("\n" + text.RULE + "\nOTC-12345")).otherwise(F.lit("\nOTC-12345"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(top, "text", end).alias("text"))
    return text.license_lines(text.body_lines(d, "doc_id"), "doc_id").select("doc_id", F.col("line_number").cast("long").alias("line_number"), "number")


@query(f"""WITH e(a, b) AS (VALUES {_VALUES}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
p AS (SELECT p_partkey, string_split(p_name, ' ') AS h, CASE p_partkey % 5 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN list_value(split_part(p_name, ' ', 1), 'llc')
  WHEN 2 THEN list_value('ruby', split_part(p_name, ' ', 2)) WHEN 3 THEN list_value('hoop', 'ruby') ELSE list_value('owner', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) END AS o FROM part),
n AS (SELECT p_partkey, h, o, list_has_any(h, o) AS share, EXISTS (SELECT 1 FROM s WHERE list_contains(h, s.a) AND list_contains(o, s.b)) AS nick FROM p)
SELECT p_partkey, CASE WHEN list_contains(o, 'llc') THEN NULL WHEN h = o OR list_has_all(o, h) THEN 'owner_name' WHEN nick AND share THEN 'owner_nickname' END AS kind FROM n""")
def name_match_types(spark, sf_dir):
    m = nicknames.token_map(_edges(spark))
    edges = F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    w = F.split("p_name", " ")
    k = F.col("p_partkey") % 5
    owner = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", w[0], F.lit("LLC"))).when(k == 2, F.concat_ws(" ", F.lit("Ruby"), w[1])).when(k == 3, "HOOP ruby").otherwise(F.concat_ws(" ", F.lit("owner"), w[0], w[1]))
    p = table(spark, sf_dir, "part").select("p_partkey", names.ascii_tokens(F.col("p_name")).alias("h"), names.ascii_tokens(owner).alias("o"))
    return p.select("p_partkey", names.name_match(F.col("h"), F.col("o"), edges).alias("kind"))


def _part_edges(spark, sf_dir):
    """Brands as names, and the types and words of their parts as nicknames."""
    p = table(spark, sf_dir, "part")
    words = F.explode(F.concat(F.array("p_type"), F.split("p_name", " ")))
    return p.select(F.col("p_brand").alias("name1"), F.lit(nicknames.RELATION).alias("relationship"), words.alias("name2")).distinct()


_PART_EDGES = "e AS (SELECT DISTINCT p_brand AS a, unnest([p_type] || string_split(p_name, ' ')) AS b FROM part)"


@query(f"WITH {_PART_EDGES} SELECT a AS name1, b AS name2 FROM e UNION SELECT b, a FROM e")
def nickname_edges_symmetric(spark, sf_dir):
    return nicknames.symmetric(_part_edges(spark, sf_dir))


@query(f"WITH {_PART_EDGES} SELECT lower(b) AS name, list(DISTINCT lower(a) ORDER BY lower(a)) AS names FROM e GROUP BY lower(b)")
def nickname_invert(spark, sf_dir):
    return nicknames.NickNamer(_part_edges(spark, sf_dir)).canonicals()


@query(f"WITH {_PART_EDGES}, l AS (SELECT a, list(DISTINCT b ORDER BY b) AS n FROM e GROUP BY a) SELECT a AS canonical_name, n[1] AS nickname_1, n[2] AS nickname_2, n[3] AS nickname_3 FROM l")
def nickname_pivot(spark, sf_dir):
    return nicknames.wide(_part_edges(spark, sf_dir), 3)


@query(f"WITH {_PART_EDGES} SELECT 'INSERT INTO names (name1, relationship, name2) VALUES (''' || a || ''', ''has_nickname'', ''' || b || ''');' AS statement FROM e")
def nickname_insert_statements(spark, sf_dir):
    return nicknames.insert_statements(_part_edges(spark, sf_dir), "names")


#: Invented hosts and businesses from the words of parts: whole, turned, cut, misspelt, and by a short name.
_NEAR = "t[1:1] || 'X' || t[3:]"
_HOSTS = f"[x || ' ' || y, y || ' ' || x, y, left(t, len(t) - 1), {_NEAR}, 'BILL ' || y, 'BILL', {_NEAR} || ' ROD', left(x, len(x) - 1) || ' ' || left(y, len(y) - 1)]"
_BUSINESSES = "[x || ' ' || y, x || ' ' || y || ' ' || t, 'WILLIAM ' || y || ' CO', t || ' ROD', t || ' ' || y || ' LLC']"
_VARIANT = ", ".join(f"('{t}', '{line.split()[0]}')" for line in names.VARIANTS.split("\n") for t in line.split())
_SAYING = f"list_filter(string_split(NAME, ' '), lambda x: len(x) >= 3 AND NOT list_contains({names.IGNORED!r}, x))"


@query(f"""WITH p AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS x, upper(split_part(p_name, ' ', 2)) AS y, p_type AS t FROM part),
v AS (SELECT DISTINCT ON (a) a, c FROM (VALUES {_VARIANT}) AS k(a, c)), m AS (SELECT map(list(a), list(c)) AS m FROM v),
a AS (SELECT a, {_SAYING.replace("NAME", "a")} AS h FROM (SELECT DISTINCT unnest({_HOSTS}) AS a FROM p)),
b AS (SELECT b, {_SAYING.replace("NAME", "b")} AS o FROM (SELECT DISTINCT unnest({_BUSINESSES}) AS b FROM p)),
c AS (SELECT a, b, h, o, len(h) AS n, list_transform(h, lambda x: coalesce(m[x], x)) AS hc, list_transform(o, lambda x: coalesce(m[x], x)) AS oc,
  list_transform(h, lambda x: list_max(list_transform(o, lambda y: 1 - levenshtein(x, y) / greatest(len(x), len(y))))) AS s,
  list_transform(h, lambda x: len(list_filter(o, lambda y: len(x) >= 4 AND len(y) >= 4 AND (starts_with(x, y) OR starts_with(y, x)))) > 0) AS pre FROM a, b, m),
d AS (SELECT a, b, CASE WHEN n = 0 OR len(o) = 0 THEN NULL WHEN a = b THEN 'exact_full_name' WHEN len(a) >= 5 AND contains(' ' || b || ' ', ' ' || a || ' ') THEN 'complete_name_in_license'
  WHEN n >= 2 AND list_has_all(o, h) THEN 'all_host_name_tokens' WHEN n = 1 AND len(h[1]) >= 4 AND list_has_all(o, h) THEN 'one_name_match'
  WHEN n = 1 AND list_bool_or(pre) THEN 'one_name_prefix_match' WHEN n >= 2 AND list_bool_and(pre) THEN 'all_name_prefix_matches'
  WHEN n = 1 AND list_has_all(oc, hc) THEN 'one_name_variant_match' WHEN n >= 2 AND list_has_all(oc, hc) THEN 'all_name_variants_match'
  WHEN len(list_filter(h, lambda x: len(x) >= 4 AND list_contains(o, x))) > 0 THEN 'partial_name_match'
  WHEN n >= 2 AND list_min(s) >= 0.84 AND list_sum(s) / n >= 0.9 THEN 'fuzzy_name_match' WHEN n = 1 AND len(h[1]) >= 5 AND s[1] >= 0.86 THEN 'fuzzy_one_name_match' END AS match_type, list_sum(s) / n AS mean FROM c)
SELECT a, b, match_type, CASE match_type WHEN 'exact_full_name' THEN 1 WHEN 'complete_name_in_license' THEN 0.97 WHEN 'all_host_name_tokens' THEN 0.94 WHEN 'one_name_match' THEN 0.78
  WHEN 'one_name_prefix_match' THEN 0.74 WHEN 'all_name_prefix_matches' THEN 0.86 WHEN 'one_name_variant_match' THEN 0.75 WHEN 'all_name_variants_match' THEN 0.9 WHEN 'partial_name_match' THEN 0.66
  ELSE round(mean, 4) END::DOUBLE AS score FROM d WHERE match_type IS NOT NULL""")
def fuzzy_name_scores(spark, sf_dir):
    """Hosts and businesses that any of the rules matches, met by the keys of their tokens."""
    p = table(spark, sf_dir, "part").select(F.upper(F.split("p_name", " ")[0]).alias("x"), F.upper(F.split("p_name", " ")[1]).alias("y"), F.col("p_type").alias("t")).distinct()
    x, y, t = F.col("x"), F.col("y"), F.col("t")
    less = lambda c: c.substr(F.lit(1), F.char_length(c) - 1)
    said = lambda *cs: F.concat_ws(" ", *cs)
    near = F.concat(F.substring(t, 1, 1), F.lit("X"), t.substr(F.lit(3), F.char_length(t)))
    made = [said(x, y), said(y, x), y, less(t), near, said(F.lit("BILL"), y), F.lit("BILL"), said(near, F.lit("ROD")), said(less(x), less(y))]
    other = [said(x, y), said(x, y, t), said(F.lit("WILLIAM"), y, F.lit("CO")), said(t, F.lit("ROD")), said(t, y, F.lit("LLC"))]
    left, right = (p.select(F.explode(F.array(*cs)).alias(c)) for cs, c in ((made, "a"), (other, "b")))
    return hosts.matched_names(left, right, "a", "b").select("a", "b", "match_type", "score")


@query("""SELECT c_custkey, round(1 - levenshtein(c_name, 'Customer#000000123') / greatest(len(c_name), 18), 6)::DOUBLE AS similarity FROM customer""")
def name_similarity(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(names.similarity(F.col("c_name"), F.lit("Customer#000000123")), 6).alias("similarity"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN false WHEN p_partkey % 6 = 1 THEN false WHEN p_partkey % 6 = 2 THEN true WHEN p_partkey % 6 = 3 THEN true WHEN p_partkey % 6 = 4 THEN true ELSE false END AS likely_hotel,
  CASE p_partkey % 6 WHEN 0 THEN 'tiny_home' WHEN 1 THEN 'user_submitted_not_hotel' WHEN 2 THEN 'hotel_submission' WHEN 3 THEN 'inn_default' WHEN 4 THEN 'hotel_words' ELSE 'none' END AS rule FROM part""")
def hotel_rules(spark, sf_dir):
    k = F.col("p_partkey") % 6
    # Few bytes and much work: as many tasks as the session says.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    title = F.when(k == 0, F.concat(F.lit("Tiny house by a hotel "), "p_name")).when(k == 3, F.concat(F.lit("The "), "p_name", F.lit(" Inn"))).otherwise(F.col("p_name"))
    description = F.when(k == 4, F.lit("Fine rooms. Welcome to our boutique hotel, with a bar.")).when(k == 5, F.lit("A flat near the Hilton. Walk to a resort.")).otherwise(F.lit("A flat."))
    fields = {"title": title, "rental_type": F.lit("Entire home"), "description": description, "host_name": F.lit("Bob")}
    return p.select("p_partkey", hotels.classify(fields, k == 2, k == 1).alias("h")).select("p_partkey", "h.likely_hotel", "h.rule")


_SUFFIX = [(alias, row.split()[0]) for row in address.SUFFIXES.split("\n") for alias in row.split()]
_SUFFIX_ROWS = ", ".join(f"({i}, '{a}', '{s}')" for i, (a, s) in enumerate(_SUFFIX))


@query(f"""WITH s(i, alias, short) AS (VALUES {_SUFFIX_ROWS})
SELECT c_custkey, c_custkey || ' E OAK ' || short AS match_key, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE '' END AS unit, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '31401' END AS zip,
  CASE WHEN c_custkey % 3 = 0 THEN 'Needs review' WHEN c_custkey % 3 = 1 THEN 'Needs review' ELSE 'Normalized' END AS status,
  CASE WHEN c_custkey % 3 = 0 THEN 'Unrecognized city/state/ZIP ending' WHEN c_custkey % 3 = 1 THEN 'Missing city in source' ELSE '' END AS notes
FROM customer JOIN s ON c_custkey % {len(_SUFFIX)} = i""")
def address_normalise(spark, sf_dir):
    """Every alias of every suffix, with and without a unit, and the ways a locality can lack."""
    k = F.col("c_custkey")
    alias = F.initcap(F.element_at(F.array(*(F.lit(a) for a, _ in _SUFFIX)), (k % len(_SUFFIX) + 1).cast("int")))
    end = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(", Georgia 31401")).otherwise(F.lit(", Savannah GA 31401"))
    raw = F.concat(k, F.lit(" East  Oak "), alias, F.when(k % 4 == 0, F.lit(" # A")).otherwise(F.lit("")), end)
    rows = table(spark, sf_dir, "customer").select("c_custkey", address.normalized(raw).alias("a"))
    return rows.select("c_custkey", "a.match_key", "a.unit", "a.zip", "a.status", "a.notes")

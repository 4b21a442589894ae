"""Queries on statuses, capacity, merges, facets, candidates' order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, coerce, labels, rules
from ..operators import candidates, merge, screening
from ..streaming import events as event_streams
from .registry import query, table

AS_OF = "1999-06-30"
_STATUS = """CASE WHEN o_orderstatus = 'F' THEN 'expired' WHEN o_orderstatus = 'O' THEN
  CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-06-30' THEN 'expired' ELSE 'current' END ELSE 'revoked' END"""


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as permits: O is issued and lapses on its date, F is expired, P is revoked."""
    o = table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "EXPIRED").when(F.col("o_orderstatus") == "O", "ISSUED").otherwise("Revoked")
    expiry = coerce.parse_date(F.date_format("o_orderdate", "M/d/yyyy"))
    return o.withColumn("status", rules.permit_status(source, expiry, F.lit(AS_OF).cast("date")))


@query(f"SELECT status, count(*) AS n, grouping(status)::INT AS is_total FROM (SELECT {_STATUS} AS status FROM orders) GROUP BY ROLLUP (status)")
def permit_status_rollup(spark, sf_dir):
    return screening.with_total(permits(spark, sf_dir), "status").orderBy(F.desc("n"), "status")


@query("""SELECT p_partkey, least(2.0 * (p_partkey % 8) + 4, 12.0) AS allowed,
  CASE WHEN p_partkey % 5 <> 0 THEN greatest(0.0, p_size - least(2.0 * (p_partkey % 8) + 4, 12.0)) WHEN p_size > 12 THEN p_size - 12.0 END AS over_one,
  CASE WHEN p_partkey % 5 <> 0 THEN greatest(0.0, p_size - CASE WHEN p_partkey % 3 = 2 THEN least(2.0 * (p_partkey % 8) + 8, 24.0) ELSE least(2.0 * (p_partkey % 8) + 4, 12.0) END)
    WHEN p_size > CASE WHEN p_partkey % 3 = 2 THEN 24 ELSE 12 END THEN p_size - CASE WHEN p_partkey % 3 = 2 THEN 24.0 ELSE 12.0 END END AS over_detected FROM part""")
def capacity_overage(spark, sf_dir):
    beds = (F.col("p_partkey") % 8).cast("double")
    known = F.when(F.col("p_partkey") % 5 != 0, beds)
    guests = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", rules.capacity(beds).alias("allowed"), rules.overage(known, guests).alias("over_one"), rules.overage(known, guests, F.col("p_partkey") % 3).alias("over_detected"))


@query("""WITH r AS (SELECT p_partkey, p_partkey % 11 = 0 AS hotel, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 8 END AS b, p_partkey % 3 AS l,
  CASE WHEN p_partkey % 7 <> 0 THEN greatest(0, p_size - least(2 * (p_partkey % 8) + 4, 12)) END AS o FROM part),
s AS (SELECT *, NOT hotel AND coalesce(b > 5, false) AS large, NOT hotel AND NOT coalesce(b > 5, false) AND l > 1 AS multiple FROM r),
t AS (SELECT *, NOT hotel AND NOT large AND NOT multiple AND o IS NULL AS unknown FROM s)
SELECT count(*) AS total, count(*) FILTER (hotel) AS hotels, count(*) FILTER (large) AS large, count(*) FILTER (multiple) AS multiple,
  count(*) FILTER (unknown) AS unknown, count(*) FILTER (NOT hotel AND NOT large AND NOT multiple AND NOT unknown) AS eligible,
  count(*) FILTER (NOT hotel AND NOT large AND NOT multiple AND NOT unknown AND o >= 1) AS over,
  round(100.0 * count(*) FILTER (NOT hotel AND NOT large AND NOT multiple AND NOT unknown AND o >= 1)
    / nullif(count(*) FILTER (NOT hotel AND NOT large AND NOT multiple AND NOT unknown), 0), 6)::DOUBLE AS percent_over FROM t""")
def occupancy_funnel(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 8).cast("double"))
    rows = p.select(F.col("p_partkey").alias("listing_id"), F.lit(0).alias("ordinal"), (F.col("p_partkey") % 11 == 0).alias("likely_hotel"), known.alias("bedrooms"), (F.col("p_partkey") % 3).alias("licenses"), F.when(known.isNotNull(), rules.overage(known, F.col("p_size").cast("double"))).alias("over_capacity"))
    return screening.funnel(rows)


@query(f"""WITH c AS (SELECT (SELECT count(*) FROM part) * 4 AS total, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) AS hotels,
  (SELECT count(*) FROM orders WHERE {_STATUS} = 'current') AS current)
SELECT total, hotels, current, greatest(0, total - hotels - current) AS shortfall,
  round(100.0 * greatest(0, total - hotels - current) / nullif(total, 0), 6)::DOUBLE AS percent, greatest(0, total - hotels - current) * 313 AS fees FROM c""")
def inventory_shortfall(spark, sf_dir):
    p = table(spark, sf_dir, "part").agg((F.count("*") * 4).alias("total"), F.count_if(F.col("p_partkey") % 11 == 0).alias("hotels"))
    current = permits(spark, sf_dir).agg(F.count_if(F.col("status") == "current").alias("current"))
    return screening.shortfall(p.join(current))  # one row and one row


@query(f"""WITH m AS (SELECT DISTINCT l_partkey, {_STATUS} AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p_partkey, CASE WHEN bool_or(status = 'current') THEN 'current' WHEN bool_or(status = 'expired') THEN 'expired'
  WHEN count(status) > 0 THEN 'other' WHEN p_partkey % 2 = 0 THEN 'unmatched' ELSE 'unknown' END AS status
FROM part LEFT JOIN m ON l_partkey = p_partkey GROUP BY p_partkey""")
def listing_status_precedence(spark, sf_dir):
    o = permits(spark, sf_dir).select("o_orderkey", "status")
    found = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.collect_set("status").alias("statuses"))
    p = table(spark, sf_dir, "part").join(found, F.col("p_partkey") == F.col("l_partkey"), "left")
    numbers = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", rules.listing_status(F.coalesce("statuses", F.array().cast("array<string>")), numbers).alias("status"))


@query(f"""SELECT o_custkey, CASE min(CASE status WHEN 'current' THEN 0 WHEN 'revoked' THEN 1 WHEN 'expired' THEN 3 END)
  WHEN 0 THEN 'current' WHEN 1 THEN 'revoked' ELSE 'expired' END AS status FROM (SELECT o_custkey, {_STATUS} AS status FROM orders) GROUP BY o_custkey""")
def parcel_best_status(spark, sf_dir):
    found = merge.parcel_status(permits(spark, sf_dir).select(F.col("o_custkey").alias("parcel"), "status"), rules.PARCEL_ORDER)
    return found.withColumnRenamed("parcel", "o_custkey")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins_evidence(spark, sf_dir):
    return merge.first_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_value(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(merge.value_by("value", "event_id").alias("value"), merge.value_by("event_type", "event_id").alias("event_type"))


def _two_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    late = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, "none").otherwise(F.upper("c_mktsegment"))
    second = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 500).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("name"), late.alias("segment"))
    return first, second


_MERGED = """f AS (SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer),
g AS (SELECT c_custkey + 500 AS c_custkey, 'new ' || c_name AS name, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE upper(c_mktsegment) END AS segment FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT coalesce(f.c_custkey, g.c_custkey) AS c_custkey, coalesce(g.name, f.name) AS name, coalesce(g.segment, f.segment) AS segment FROM f FULL JOIN g ON f.c_custkey = g.c_custkey)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def precedence_merge(spark, sf_dir):
    return merge.merge_sources([*_two_sources(spark, sf_dir)], "c_custkey", ["name", "segment"])


@query(f"""WITH {_MERGED} SELECT coalesce(f.c_custkey, m.c_custkey) AS c_custkey, u.field, u.before, u.after FROM f FULL JOIN m ON f.c_custkey = m.c_custkey,
  LATERAL (SELECT 'name' AS field, f.name AS before, m.name AS after UNION ALL SELECT 'segment', f.segment, m.segment) u WHERE u.before IS DISTINCT FROM u.after""")
def precedence_merge_audit(spark, sf_dir):
    first, second = _two_sources(spark, sf_dir)
    merged = merge.merge_sources([first, second], "c_custkey", ["name", "segment"])
    return merge.repairs(first, merged, "c_custkey", ["name", "segment"])


@query("""WITH x AS (SELECT c_custkey % 1000 AS k, max(c_custkey) AS number FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1)
SELECT o_orderkey, coalesce('C' || number, 'O' || o_orderkey) AS permit_number FROM orders LEFT JOIN x ON o_custkey = k""")
def crosswalk_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.concat(F.lit("O"), "o_orderkey").alias("permit_number"))
    x = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("k"), F.concat(F.lit("C"), "c_custkey").alias("permit_number"), F.col("c_custkey").alias("ordinal"), F.when(F.col("c_nationkey") % 5 != 0, "url").otherwise(" ").alias("source_url"))
    return merge.with_crosswalk(o, x, "k").select("o_orderkey", "permit_number")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_STATUS} = 'current')")
def licensed_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(permits(spark, sf_dir).where("status = 'current'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_STATUS} = 'current')")
def unlicensed_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(permits(spark, sf_dir).where("status = 'current'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"""SELECT l_partkey AS listing_id, list(DISTINCT {_STATUS} || ':' || o_orderkey ORDER BY {_STATUS} || ':' || o_orderkey) AS permits
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def matched_permit_lists(spark, sf_dir):
    numbers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("listing_id")).agg(F.collect_set("l_orderkey").alias("permit_numbers"))
    p = permits(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("permit_number"), "status")
    out = merge.matched_permits(numbers, p)
    return out.select("listing_id", F.array_sort(F.transform("permits", lambda x: F.concat_ws(":", x.status, x.id))).alias("permits"))


@query("""SELECT coalesce(event_type, '') AS event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def json_props_facets(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>"))
    return e.groupBy(F.coalesce("event_type", F.lit("")).alias("event_type"), F.col("p")["k"].alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT count(DISTINCT event_type) AS kinds, max(n) AS most, sum(n)::BIGINT AS total FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def count_by_value_map(spark, sf_dir):
    m = F.col("counts")
    return screening.count_map(table(spark, sf_dir, "events"), "event_type").select(F.size(m).cast("long").alias("kinds"), F.array_max(F.map_values(m)).alias("most"), F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""SELECT count(*) AS listings, count(*) FILTER (o_totalprice > 250000) AS large, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent,
  count(DISTINCT o_custkey) AS hosts, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders""")
def build_report_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("listings"), F.count_if(F.col("o_totalprice") > 250000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count_distinct("o_custkey").alias("hosts"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name || ' ' || lower(c_mktsegment) LIKE '%build%' ORDER BY c_custkey LIMIT 100 OFFSET 100")
def record_search_page(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hits = c.where(F.contains(coerce.record_text("c_name", "c_mktsegment"), F.lit("build")))
    return screening.page(hits, ["c_custkey"], 1).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 25)::BIGINT AS part FROM customer")
def fixed_size_parts(spark, sf_dir):
    return merge.parts(table(spark, sf_dir, "customer"), "c_custkey", 25, ["c_nationkey"]).select("c_custkey", "part")


def listings(spark, sf_dir):
    """Parts as listings: words of the name are amenities, the brand is the host."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select("p_partkey", F.lower("p_name").alias("search"), F.col("p_brand").alias("host_key"), F.col("p_type").alias("rental_type"), words.alias("amenities"), F.array_join(F.array_sort(words), "|").alias("combo"), F.greatest(F.lit(0), F.col("p_size") - 20).cast("double").alias("overage"), (F.col("p_partkey") % 4 == 0).alias("party"), (F.col("p_partkey") % 3 == 0).alias("likely"))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND greatest(0, p_size - 20) >= 5 AND p_partkey % 4 <> 0 AND (list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'ring'))")
def faceted_filter(spark, sf_dir):
    f = screening.Facets(rental_type="ECONOMY", least_overage=5.0, party=False, amenities_any=("red", "ring"))
    return f.apply(listings(spark, sf_dir)).select("p_partkey")


@query("SELECT coalesce(p_type, '') AS rental_type, count(*) AS n FROM part WHERE greatest(0, p_size - 20) >= 5 AND p_partkey % 4 <> 0 GROUP BY 1")
def facet_counts_skip_self(spark, sf_dir):
    f = screening.Facets(rental_type="ECONOMY", least_overage=5.0, party=False)
    return f.counts(listings(spark, sf_dir), "rental_type", "rental_type")


_LISTED = "l AS (SELECT p_type, p_brand, p_partkey % 4 = 0 AS party, greatest(0, p_size - 20) AS overage, p_partkey % 3 = 0 AS likely FROM part)"


@query(f"""WITH {_LISTED}
SELECT 'rental_type' AS facet, coalesce(p_type, '') AS value, count(*) AS n FROM l WHERE p_brand = 'Brand#13' AND overage >= 3 AND NOT party GROUP BY ALL
UNION ALL SELECT 'host', coalesce(p_brand, ''), count(*) FROM l WHERE p_type = 'ECONOMY' AND overage >= 3 AND NOT party GROUP BY ALL
UNION ALL SELECT 'party', party::VARCHAR, count(*) FROM l WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#13' AND overage >= 3 GROUP BY ALL
UNION ALL SELECT 'likely_unlicensed', likely::VARCHAR, count(*) FROM l WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#13' AND overage >= 3 AND NOT party GROUP BY ALL""")
def facet_counts_at_once(spark, sf_dir):
    """The counts of four facets, one of them without a condition, from one scan."""
    f = screening.Facets(rental_type="ECONOMY", host="Brand#13", least_overage=3.0, party=False)
    return f.all_counts(listings(spark, sf_dir), {"rental_type": "rental_type", "host": "host_key", "party": "party", "likely_unlicensed": "likely"})


@query("""SELECT p_brand AS host_key, count(*) AS total, count(*) FILTER (p_partkey % 3 = 0) AS likely, count(*) FILTER (p_partkey % 4 = 0) AS party,
  count(*) FILTER (p_size > 20) AS over FROM part GROUP BY 1""")
def host_rollup_sorted(spark, sf_dir):
    return screening.sorted_hosts(screening.hosts(listings(spark, sf_dir)), "likely")


@query("SELECT p_brand AS host_key, array_to_string(list_sort(string_split(p_name, ' ')), '|') AS combo, count(*) AS n FROM part WHERE p_partkey % 4 = 0 OR p_size > 20 GROUP BY ALL")
def combo_counts(spark, sf_dir):
    return screening.host_combos(listings(spark, sf_dir))


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND (p_partkey % 4 = 0 OR p_size > 20) AND p_partkey % 5 NOT IN (1, 2)")
def faceted_sets(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("community_status", F.when(F.col("p_partkey") % 5 == 1, "no_license_at_address").when(F.col("p_partkey") % 5 == 2, "license_at_address").otherwise("none"))
    return screening.Facets(rental_types=("ECONOMY", "STANDARD", "PROMO"), party=True, community=("undetermined",)).apply(rows).select("p_partkey")


@query("""SELECT count(*) AS listings, count(*) FILTER (p_partkey % 4 <> 0) AS known, count(*) FILTER (p_partkey % 4 <> 0 AND p_size > 20) AS likely, count(*) FILTER (p_partkey % 4 = 0) AS unknown,
  round(100.0 * count(*) FILTER (p_partkey % 4 <> 0 AND p_size > 20) / nullif(count(*) FILTER (p_partkey % 4 <> 0), 0), 6)::DOUBLE AS percent FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def spatial_screening_rate(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((k % 11 == 0).alias("likely_hotel"), (k % 7 != 0).alias("in_scope"), F.when(k % 4 != 0, F.col("p_size") <= 20).alias("overlap"))
    return screening.spatial_rate(rows)


@query("""SELECT p_partkey, CASE WHEN h THEN '#f97316' WHEN s = 'expired' THEN '#facc15' WHEN s = 'current' THEN '#22c55e' WHEN o THEN '#fb7185' WHEN s = 'other' THEN '#c4b5fd' ELSE '#e2e8f0' END AS color,
  CASE WHEN o THEN '#dc2626' ELSE '#2563eb' END AS stroke, p_size || CASE WHEN o THEN chr(10) || '+' || (p_size - 20) ELSE '' END AS label
FROM (SELECT p_partkey, p_size, p_partkey % 11 = 0 AS h, p_size > 20 AS o, CASE p_partkey % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'current' WHEN 2 THEN 'other' ELSE 'unknown' END AS s FROM part)""")
def marker_styles(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "expired").when(k % 4 == 1, "current").when(k % 4 == 2, "other").otherwise("unknown")
    over = F.col("p_size") > 20
    return table(spark, sf_dir, "part").select("p_partkey", labels.marker_color(k % 11 == 0, status, over).alias("color"), labels.marker_stroke(over).alias("stroke"), labels.marker_label(F.col("p_size"), F.col("p_size") - 20, over).alias("label"))


@query("""WITH m AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0), f AS (SELECT l_orderkey, bool_or(l_partkey % 3 = 0) AS y, bool_or(l_partkey % 3 <> 0) AS n FROM m GROUP BY l_orderkey),
j AS (SELECT o_orderkey, o_orderkey % 13 = 0 AS h, o_orderkey % 5 = 0 AS near, coalesce(y, false) AS y, coalesce(n, false) AS n FROM orders LEFT JOIN f ON o_orderkey = l_orderkey)
SELECT o_orderkey AS listing_id, CASE WHEN h THEN 'hotel' WHEN y AND NOT n THEN 'licensed' WHEN near THEN 'nearby' WHEN n AND NOT y THEN 'unlicensed' ELSE 'unknown' END AS auto_status FROM j""")
def auto_match_statuses(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("listing_id"), (k % 13 == 0).alias("likely_hotel"), F.lit(None).cast("boolean").alias("overlap"), F.when(k % 5 == 0, 9.0).otherwise(900.0).alias("nearest_licensed_parcel_m"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "permit_owner_name").otherwise("distance")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("listing_id"), kind.alias("type"), F.concat(F.lit("p-"), "l_partkey").alias("parcel"))
    current = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("parcel"))
    return candidates.auto_match(rows, found, current)


@query("""SELECT c_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 256)::INT AS bucket,
  substr(sha256(c_name), 1, 2) AS shard, right(c_name, 2) AS tail FROM customer""")
def poly_hash_buckets(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_name", buckets.polynomial(c).cast("int").alias("bucket"), buckets.sha_prefix(c).alias("shard"), buckets.tail(c).alias("tail"))


@query("""SELECT upper(c_mktsegment) || ' ' || c_nationkey AS address, list(DISTINCT c_custkey % 50 ORDER BY c_custkey % 50) AS tiles,
  list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(c_mktsegment) || ' ' || c_nationkey, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 256)::INT AS bucket FROM customer GROUP BY 1""")
def address_index_shards(spark, sf_dir):
    tiles = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("tile"), F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  "), "c_nationkey").alias("address"))
    shards, _ = candidates.address_index(tiles)
    return shards.select("address", "tiles", F.col("bucket").cast("int").alias("bucket"))


@query("SELECT o_orderkey, o_totalprice >= 100000 OR o_orderkey % 7 = 0 AS kept FROM orders")
def scope_partition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") - 100000))
    kept, left = merge.same_partition(rows, F.col("d") >= 0)
    return kept.select("o_orderkey", F.lit(True).alias("kept")).union(left.select("o_orderkey", F.lit(False).alias("kept")))


@query("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def distinct_union_subset(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.union(s).distinct().subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, ts DESC) AS r FROM events) WHERE r = 1""")
def latest_submission_priority(spark, sf_dir):
    return merge.latest_submission(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "purchase").select("user_id", "event_id", "event_type")


@query("""SELECT 'ok' AS kind, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS x FROM events) WHERE x IS NOT NULL
UNION ALL SELECT 'bad', count(*), NULL FROM events WHERE event_id % 5 = 0""")
def number_coercion(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).when(F.col("event_id") % 10 == 0, "5d").otherwise("NaN")
    rows = table(spark, sf_dir, "events").select(coerce.number(raw).alias("x"))
    return rows.groupBy(F.when(F.col("x").isNotNull(), "ok").otherwise("bad").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def date_parsing(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(F.col("o_orderkey") % 3 == 0, "31.12.99").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.parse_date(raw).alias("day"))


@query("SELECT event_id, event_type FROM events")
def event_dedup_stream(spark, sf_dir):
    twice = event_streams.stream(spark, sf_dir).union(event_streams.stream(spark, sf_dir))
    return event_streams.deduplicated(twice).select("event_id", "event_type")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def event_tumbling_stream(spark, sf_dir):
    rows = event_streams.tumbling(event_streams.stream(spark, sf_dir))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")

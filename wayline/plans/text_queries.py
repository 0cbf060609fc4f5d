"""Text function queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.functions.geo import request_signature
from wayline.functions.numbers import knots_to_mph, meters_to_miles, mps_to_mph, round_half_up
from wayline.functions.times import delay_label, iso_time_since_2000, micros
from wayline.plans.base import FIX, NOW_S, fixes, now, query, r6, table, with_ctes

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def html_text_sql(source: str) -> str:
    ref = "regexp_extract(p, '^([A-Za-z]+|#[0-9]+);', 1)"
    named = "CASE lower(n) WHEN 'amp' THEN '&' WHEN 'quot' THEN '\"' WHEN 'apos' THEN '''' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'nbsp' THEN ' ' END"
    number = "CASE WHEN starts_with(n, '#') THEN chr(CAST(nullif(substr(n, 2), '') AS INTEGER)) END"
    named_i = named.replace("lower(n)", f"lower({ref})")
    number_i = number.replace("substr(n, 2)", f"substr({ref}, 2)").replace("starts_with(n, '#')", f"starts_with({ref}, '#')")
    dec = f"CASE WHEN {ref} != '' AND coalesce({number_i}, {named_i}) IS NOT NULL THEN coalesce({number_i}, {named_i}) || substr(p, length({ref}) + 2) ELSE '&' || p END"
    parts = f"string_split(regexp_replace({source}, '<[^>]*>', ' ', 'g'), '&')"
    body = f"list_extract({parts}, 1) || array_to_string(list_transform(list_slice({parts}, 2, len({parts})), lambda p: {dec}), '')"
    return f"trim(regexp_replace({body}, '{WS}', ' ', 'g'))"


@query("FN12", f"SELECT page_id, {html_text_sql('html')} AS body FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query("FN12 FN13", f"""SELECT page_id, {html_text_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(html, '(?i)href=["'']([^"'']+)["'']', 1) AS first_link,
 regexp_matches(url, '^https://') AS secure FROM pages""")
def html_elements(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", X.html_element(h, "title").alias("title"), X.html_attribute(h, "href").alias("first_link"), X.is_https(F.col("url")).alias("secure"))


@query("FN13 SRC12", """SELECT page_id, CAST(page_id AS VARCHAR) || ':00 PM' AS started, '' AS missing, 'Lane ' || page_id || ' & ramp' AS details, url AS image FROM pages""")
def html_cells(spark, sf):
    u, p = F.col("url"), F.col("page_id").cast("string")
    doc = F.concat(
        F.lit("<table><tr><td class='d' COLSPAN=\"2\"><b>Lane</b> "), p, F.lit("\n &amp;&nbsp;ramp</td></tr><tr><TH scope='row'> Start Time </TH>\n<td> <i>"), p,
        F.lit(":00&#32;PM</i></td></tr></table>"), F.col("html"), F.lit("<img DATA-LAZY='"), u, F.lit("'>"),
    )
    t = table(spark, sf, "pages").withColumn("doc", doc)
    d = F.col("doc")
    return t.select(
        "page_id", X.html_cell(d, "Start Time").alias("started"), X.html_cell(d, "Anticipated End Time").alias("missing"),
        X.html_description(d).alias("details"), X.html_attribute(d, "data-lazy").alias("image"),
    )


SQUEEZED = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"


@query("FN25", f"SELECT doc_id, left({SQUEEZED}, 280) AS note, CAST(length({SQUEEZED}) AS INTEGER) AS full_length FROM documents")
def squeezed_notes(spark, sf):
    s = X.squeeze(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.truncate(s, 280).alias("note"), F.length(s).alias("full_length"))


@query("FN14", """
SELECT p_partkey, CASE WHEN s != '' AND l != '' AND NOT contains(lower(l), lower(s)) THEN s || ' · ' || l ELSE coalesce(nullif(s, ''), nullif(l, ''), CAST(p_partkey AS VARCHAR)) END AS label
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS s, CASE p_partkey % 5 WHEN 0 THEN '' ELSE trim(p_name) END AS l FROM part)""")
def route_labels(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    s = F.when(k % 4 == 0, "").when(k % 4 == 1, F.split_part(n, F.lit(" "), F.lit(1))).otherwise(F.col("p_brand"))
    lg = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), n))
    return table(spark, sf, "part").select("p_partkey", X.route_label(s, lg, k.cast("string")).alias("label"))


@query("FN16", """SELECT p_partkey, concat_ws(' · ', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 != 0 THEN p_type END, p_name) AS line FROM part""")
def join_nonempty(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", X.join_non_empty(" · ", F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), F.when(k % 3 != 0, F.col("p_type")), F.col("p_name")).alias("line")
    )


@query("FN17", """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+'), lambda w: CASE WHEN starts_with(w, 'ß') THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || lower(substr(w, 2))), '') AS title FROM documents""")
def title_case(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.title_case(F.col("text")).alias("title"))


@query("FN18", """SELECT o_orderkey, CASE WHEN a = b THEN 'Daily ' || replace(a, ' / ', '–') ELSE coalesce(nullif(concat_ws(' · ', 'Mon ' || replace(a, ' / ', '–'), 'Sat ' || replace(b, ' / ', '–')), ''), 'Hours vary; verify before travel') END AS hours
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 != 0 THEN (o_orderkey % 4) || ':00 / 18:00' END AS a, CASE WHEN o_orderkey % 5 != 0 THEN (o_orderkey % 2) || ':00 / 18:00' END AS b FROM orders)""")
def opening_hours(spark, sf):
    k = F.col("o_orderkey")
    span = lambda m: F.concat((k % m).cast("string"), F.lit(":00 / 18:00"))
    return table(spark, sf, "orders").select(k, X.opening_hours(F.when(k % 3 != 0, span(4)).otherwise(""), F.when(k % 5 != 0, span(2)).otherwise("")).alias("hours"))


@query("FN19", with_ctes(FIX, """
SELECT id, CASE grp WHEN 'view' THEN 'Stopped at ' || s WHEN 'click' THEN 'Arriving at ' || s WHEN 'error' THEN 'Next stop ' || s ELSE 'In service' END AS status
FROM (SELECT id, grp, CASE WHEN id % 3 = 0 THEN 'station' ELSE source END AS s FROM fix)"""))
def status_phrases(spark, sf):
    g = F.col("grp")
    state = F.when(g == "view", "STOPPED_AT").when(g == "click", "INCOMING_AT").when(g == "error", "IN_TRANSIT_TO").otherwise(g)
    return fixes(spark, sf).select("id", X.status_phrase(state, F.when(F.col("id") % 3 == 0, "").otherwise(F.col("source"))).alias("status"))


@query("FN21", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.amtrak.com/' || page_id WHEN page_id % 3 = 1 THEN trim(url) ELSE 'https://fallback.example/' END AS source_url, page_id % 3 != 1 OR starts_with(url, 'https://') AS secure FROM pages""")
def source_urls(spark, sf):
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" http://www.amtrak.com/"), k.cast("string"))).when(k % 3 == 1, F.col("url")).otherwise("")
    t = table(spark, sf, "pages").select("page_id", X.source_url(raw, F.lit("https://fallback.example/")).alias("source_url"))
    return t.withColumn("secure", X.is_https(F.col("source_url")))


@query("FN08 ST05", with_ctes(FIX, """
SELECT id, CASE WHEN id % 13 = 0 THEN '' WHEN m >= 2 THEN m || ' min late' WHEN m <= -2 THEN abs(m) || ' min early' ELSE 'on time' END AS delay FROM (SELECT id, CAST(floor((id % 1201 - 600) / 60.0 + 0.5) AS BIGINT) AS m FROM fix)"""))
def delay_labels(spark, sf):
    at = F.when(F.col("id") % 13 != 0, F.timestamp_micros(F.col("ts_us") + (F.col("id") % 1201 - 600) * 1_000_000))
    return fixes(spark, sf).select("id", delay_label(F.col("updated_at"), at).alias("delay"))


@query("FN09", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderdate <= TIMESTAMP '2000-01-01' THEN CAST({NOW_S} AS BIGINT) * 1000000 ELSE epoch_us(o_orderdate) END AS at_us FROM orders""")
def iso_times(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return table(spark, sf, "orders").select("o_orderkey", micros(iso_time_since_2000(text, now())).alias("at_us"))


@query("FN15", with_ctes(FIX, "SELECT id, CAST(floor(speed * 2.23694 + 0.5) AS BIGINT) AS mph, round(speed * 1.15078, 6) AS knot_mph, round(speed / 1609.344, 6) AS miles FROM fix"))
def unit_conversions(spark, sf):
    v = F.col("speed")
    return fixes(spark, sf).select("id", round_half_up(mps_to_mph(v)).alias("mph"), r6(knots_to_mph(v)).alias("knot_mph"), r6(meters_to_miles(v)).alias("miles"))


@query("FN24", "SELECT p_partkey, 'osrm-driving-bus-controls-v4|' || p_brand || '|driving:' || p_name AS signature FROM part")
def request_signatures(spark, sf):
    return table(spark, sf, "part").select("p_partkey", request_signature("osrm-driving-bus-controls-v4", F.col("p_brand"), F.concat(F.lit("driving:"), "p_name")).alias("signature"))

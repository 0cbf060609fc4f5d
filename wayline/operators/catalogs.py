"""Reference catalogs: landing facilities, border crossings, roads, rail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.numbers import clean_number, fixed_text, plain_text, safe_number
from wayline.functions.text import join_non_empty, non_empty, opening_hours, squeeze, title_case, truncate
from wayline.operators.normalise import decode


def open_facilities(rows: DataFrame) -> DataFrame:
    states = [s.upper() for s in V.STATE_IDS]
    placed = non_empty(F.col("LAT_DECIMAL")).isNotNull() & non_empty(F.col("LONG_DECIMAL")).isNotNull()
    return rows.where(F.col("STATE_CODE").isin(*states) & (F.col("ARPT_STATUS") == "O") & placed)


def facilities(rows: DataFrame) -> DataFrame:
    """Landing-facility features of open facilities (``schemas.AIRPORT``)."""
    public = F.coalesce(F.col("FACILITY_USE_CODE") == "PU", F.lit(False))
    kind = decode(F.col("SITE_TYPE_CODE"), V.FACILITY_TYPES, "Landing facility")
    owner = decode(F.col("OWNERSHIP_TYPE_CODE"), V.OWNERSHIP_TYPES, "Other ownership")
    icao = F.when(F.col("ICAO_ID") != F.col("ARPT_ID"), non_empty(F.col("ICAO_ID")))
    feet = clean_number(F.col("ELEV"))
    return open_facilities(rows).select(
        safe_number(F.col("LONG_DECIMAL")).alias("lng"), safe_number(F.col("LAT_DECIMAL")).alias("lat"),
        F.lit("airport").alias("grp"), F.lit("reference").alias("data_status"), title_case(F.col("ARPT_NAME")).alias("title"),
        F.concat(F.when(public, "Public use ").otherwise("Private use "), F.lower(kind)).alias("status"),
        F.concat_ws(
            " · ", F.concat(title_case(F.col("CITY")), F.lit(", "), F.col("STATE_CODE")), F.concat_ws(" / ", "ARPT_ID", icao), owner,
            F.concat(plain_text(feet), F.lit(" ft elevation")),
        ).alias("details"),
        F.col("ARPT_ID").alias("faa_id"), F.col("ICAO_ID").alias("icao"), kind.alias("facility_type"),
        F.when(public, "public").otherwise("private").alias("facility_use"), F.lower("STATE_CODE").alias("state"),
        title_case(F.col("COUNTY_NAME")).alias("county"), F.col("EFF_DATE").alias("effective_date"),
    )


def facility_metadata(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("facility_use") == "public").alias("public_use_count"),
        F.min("effective_date").alias("effective_date"),
    )


def _has_any(text: Column, *tokens: str) -> Column:
    found = F.lit(False)
    for t in tokens:
        found = found | F.contains(text, F.lit(t))
    return found


def select_crossings(offices: DataFrame) -> DataFrame:
    """Offices ``(office_name, us_port, province, services, …)`` on the region's border."""
    port = F.upper("us_port")
    return offices.where(
        F.col("province").isin(*V.BORDER_PROVINCES) & (F.coalesce("us_port", F.lit("")) != "")
        & _has_any(port, *V.PORTS_OF_THE_REGION)
        & ~_has_any(port, V.CLOSED_PORT) & _has_any(F.col("services"), *V.ROAD_SERVICES[:1], *V.RAIL_SERVICES, *V.FERRY_SERVICES, *V.ROAD_SERVICES[1:])
    )


def crossings(offices: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Crossing features; an office without a geocode keeps null coordinates and is listed by ``ungeocoded``."""
    services = F.col("services")
    kinds = F.concat_ws(
        " + ", F.when(_has_any(services, *V.ROAD_SERVICES), "road"), F.when(_has_any(services, *V.RAIL_SERVICES), "rail"),
        F.when(_has_any(services, *V.FERRY_SERVICES), "ferry"),
    )
    port = F.replace("us_port", F.lit(" Station"), F.lit(""))
    upper = F.upper(port)
    region = (
        F.when(_has_any(upper, *V.VERMONT_PORTS), "vt").when(_has_any(upper, *V.NEW_HAMPSHIRE_PORTS), "nh").otherwise("me")
    )
    notes = truncate(squeeze(F.coalesce("notes", F.lit(""))), 280)
    rows = select_crossings(offices).withColumn("key", F.concat_ws("|", "office_name", "us_port")).join(geocodes, "key", "left")
    return rows.withColumn("kinds", F.coalesce(non_empty(kinds), F.lit("border"))).select(
        "key", "lng", "lat", F.lit("border").alias("grp"), F.lit("reference").alias("data_status"), F.col("office_name").alias("title"),
        F.concat(F.lit("Canada–U.S. "), F.col("kinds"), F.lit(" crossing · "), port).alias("status"),
        join_non_empty(
            " · ", opening_hours(F.col("hours_weekday"), F.col("hours_weekend")),
            F.when(_has_any(services, "PPTRA-Q"), "remote-traveller pilot location"), F.when(F.col("seasonal") == "True", "seasonal hours"), notes,
        ).alias("details"),
        F.col("kinds").alias("crossing_type"), port.alias("us_port"), "province", F.array(region).alias("regions"),
    )


def ungeocoded(offices: DataFrame, geocodes: DataFrame) -> DataFrame:
    return select_crossings(offices).withColumn("key", F.concat_ws("|", "office_name", "us_port")).join(geocodes, "key", "left_anti")


def roads(rows: DataFrame) -> DataFrame:
    """Road features from ``(row_ix, NAME, RTTYP, geometry)``."""
    return rows.select(
        F.concat(F.lit("road-"), F.col("row_ix").cast("string")).alias("id"), F.lit("roads").alias("grp"),
        F.lit("reference").alias("data_status"), F.lit(V.NO_COLOR).alias("color"),
        F.coalesce(non_empty(F.col("NAME")), F.lit("Primary roadway")).alias("title"),
        decode(F.col("RTTYP"), V.ROAD_TYPES, "Primary roadway").alias("status"),
        F.lit("U.S. Census Bureau TIGERweb").alias("provider"),
    )


def select_rail(rows: DataFrame) -> DataFrame:
    states = [s.upper() for s in V.STATE_IDS]
    return rows.where(F.col("STATEAB").isin(*states) & F.col("NET").isin(*V.RAIL_TYPES))


def rail(rows: DataFrame) -> DataFrame:
    """Rail features from ``schemas``-style columns of the rail pages."""
    tracks, miles = F.col("TRACKS"), safe_number(F.col("MILES"))
    subdivision = F.trim(F.coalesce(non_empty(F.col("SUBDIV")), F.col("BRANCH"), F.lit("")))
    count = F.concat(tracks.cast("string"), F.lit(" track"), F.when(tracks == 1, "").otherwise("s"))
    return select_rail(rows).select(
        F.concat(F.lit("rail-"), F.col("FRAARCID").cast("string")).alias("id"), F.lit("freight").alias("grp"),
        F.lit("reference").alias("data_status"), F.lit("#b98b72").alias("color"),
        join_non_empty(" · ", F.coalesce(non_empty(F.col("RROWNER1")), F.lit("Rail network")), subdivision, F.trim(F.coalesce("YARDNAME", F.lit("")))).alias("title"),
        join_non_empty(
            " · ", F.trim(F.concat_ws(" ", "STATEAB", decode(F.col("NET"), V.RAIL_TYPES, "rail infrastructure"))), count,
            F.concat(fixed_text(miles, 1), F.lit(" mi segment")),
        ).alias("status"),
        F.lit("Federal Railroad Administration · NTAD").alias("provider"),
    )


def geocodes_out_of_range(geocodes: DataFrame) -> DataFrame:
    """Geocodes ``(key, lng, lat)`` outside the region's box or without a position; a build with any of them has to stop."""
    west, south, east, north = V.GEOCODE_BOX
    inside = F.col("lng").between(west, east) & F.col("lat").between(south, north)
    return geocodes.where(~F.coalesce(inside, F.lit(False)))

"""Text rules: HTML, labels, joins, case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: named character references that are decoded
NAMED_REFERENCES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " "}

SPACES = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def non_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def join_non_empty(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[non_empty(p) for p in parts])


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def truncate(x: Column, limit: int) -> Column:
    return F.left(x, F.lit(limit))


def _decode_reference(tail: Column) -> Column:
    """``tail`` follows an ampersand; decode it if it opens with a complete reference."""
    name = F.regexp_extract(tail, r"^([A-Za-z]+|#[0-9]+);", 1)
    rest = F.substring(tail, F.length(name) + F.lit(2), F.length(tail))
    code = F.substring(name, F.lit(2), F.lit(18)).try_cast("bigint")
    unit = F.decode(F.unhex(F.lpad(F.hex(F.pmod(code, F.lit(65536))), 4, "0")), "UTF-16BE")
    named = F.lit(None).cast("string")
    for key, value in NAMED_REFERENCES.items():
        named = F.when(F.lower(name) == key, F.lit(value)).otherwise(named)
    decoded = F.when(F.startswith(name, F.lit("#")), unit).otherwise(named)
    return F.when((name != "") & decoded.isNotNull(), F.concat(decoded, rest)).otherwise(F.concat(F.lit("&"), tail))


def html_text(html: Column) -> Column:
    """Drop tags, decode references in one pass, squeeze white space."""
    pieces = F.split(F.regexp_replace(html, r"<[^>]*>", " "), "&")
    decoded = F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decode_reference), ""),
    )
    return squeeze(decoded)


def _first_group(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, pattern, 1)


def html_cell(html: Column, label: str) -> Column:
    """Text of the cell that follows the header cell ``label``."""
    pattern = rf"(?is)<th[^>]*>\s*{re.escape(label)}\s*</th>\s*<td[^>]*>(.*?)</td>"
    return html_text(_first_group(html, pattern))


def html_description(html: Column) -> Column:
    return html_text(_first_group(html, r"(?is)<td[^>]*colspan=[\"']?2[\"']?[^>]*>(.*?)</td>"))


def html_element(html: Column, tag: str) -> Column:
    return html_text(_first_group(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"))


def html_attribute(html: Column, attribute: str) -> Column:
    return _first_group(html, rf"(?i){attribute}=[\"']([^\"']+)[\"']")


def camera_direction(html: Column) -> Column:
    return html_text(_first_group(html, r"(?is)class=[\"']dirDescHeader[\"'][^>]*>(.*?)</div>"))


def title_case(x: Column) -> Column:
    """Capital after any non-letter, lower case elsewhere."""
    def word(w: Column) -> Column:
        head = F.upper(F.substring(w, 1, 1))
        return F.concat(F.substring(head, 1, 1), F.lower(F.substring(head, 2, 8)), F.substring(w, 2, 1_000_000_000))

    # cut before every word start, so a piece holds one word and what follows it
    return F.array_join(F.transform(F.split(F.lower(x), r"(?<!\p{L})(?=\p{L})"), word), "")


def route_label(short: Column, long: Column, route_id: Column) -> Column:
    s, lg = F.trim(F.coalesce(short, F.lit(""))), F.trim(F.coalesce(long, F.lit("")))
    both = (s != "") & (lg != "") & ~F.contains(F.lower(lg), F.lower(s))
    return F.when(both, F.concat(s, F.lit(" · "), lg)).otherwise(
        F.coalesce(non_empty(s), non_empty(lg), route_id, F.lit("Route"))
    )


def translated(translations: Column) -> Column:
    """English text, else the first one not marked as HTML, else the first."""
    english = F.filter(translations, lambda t: t["language"] == "en")
    plain = F.filter(translations, lambda t: ~F.coalesce(F.contains(t["language"], F.lit("html")), F.lit(False)))
    return F.coalesce(F.get(english, F.lit(0))["text"], F.get(plain, F.lit(0))["text"],
                      F.get(translations, F.lit(0))["text"], F.lit(""))


def status_phrase(status: Column, stop_name: Column) -> Column:
    stop = F.coalesce(non_empty(stop_name), F.lit("station"))
    return (
        F.when(status == "STOPPED_AT", F.concat(F.lit("Stopped at "), stop))
        .when(status == "INCOMING_AT", F.concat(F.lit("Arriving at "), stop))
        .when(status == "IN_TRANSIT_TO", F.concat(F.lit("Next stop "), stop))
        .otherwise("In service")
    )


def pretty_effect(effect: Column) -> Column:
    s = F.lower(F.replace(effect, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000_000))


def source_url(url: Column, fallback: Column) -> Column:
    chosen = F.trim(F.coalesce(non_empty(url), non_empty(fallback), F.lit("")))
    return F.regexp_replace(chosen, r"^http://www\.amtrak\.com/", "https://www.amtrak.com/")


def is_https(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("https://")), F.lit(False))


def opening_hours(weekday: Column, weekend: Column) -> Column:
    def span(x: Column) -> Column:
        return F.replace(x, F.lit(" / "), F.lit("–"))

    day, end = non_empty(weekday), non_empty(weekend)
    separate = F.concat_ws(" · ", F.concat(F.lit("Mon "), span(day)), F.concat(F.lit("Sat "), span(end)))
    return F.when(day == end, F.concat(F.lit("Daily "), span(day))).otherwise(
        F.coalesce(non_empty(separate), F.lit("Hours vary; verify before travel"))
    )


def alert_severity(text: Column, severe: str, delay: str) -> Column:
    return F.when(F.rlike(text, F.lit(severe)), 8).when(F.rlike(text, F.lit(delay)), 6).otherwise(4)

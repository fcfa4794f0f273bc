"""Dates as web servers and feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?"
_ZONE = r"\s*([zZ]|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_ISO = rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]\s*{_TIME}{_ZONE})?$"
_RFC = rf"(?i)^(?:[a-z]+,?\s+)?(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -](\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}$"
_ASC = rf"(?i)^[a-z]+\s+([a-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{_TIME}\s+(\d{{4}}){_ZONE}$"


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 (UTC) of a date in ISO 8601, RFC 1123, RFC 850 or asctime notation.

    Without a zone the date is UTC, whatever the session's time zone; a day alone is its midnight; two-digit years are
    2000-2069 and 1970-1999. Null, empty, unreadable and impossible dates give null.
    """
    s = F.trim(text)
    # one replacement brings a notation's parts into one order: year, month, day, hour, minute, second, fraction, zone
    parts = (
        F.when(s.rlike(_ISO), F.regexp_replace(s, _ISO, "$1|$2|$3|$4|$5|$6|$7|$8"))
        .when(s.rlike(_RFC), F.regexp_replace(s, _RFC, "$3|$2|$1|$4|$5|$6|$7|$8"))
        .when(s.rlike(_ASC), F.regexp_replace(s, _ASC, "$7|$1|$2|$3|$4|$5|$6|$8"))
    )
    return F.transform(F.array(F.split(parts, r"\|", -1)), _from_parts)[0]


def _from_parts(a: Column) -> Column:
    two = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    year = F.when(F.length(a[0]) == 4, a[0]).when(a[0] >= "70", F.concat(F.lit("19"), a[0])).otherwise(F.concat(F.lit("20"), a[0]))
    month = F.when(a[1].rlike("^[0-9]"), a[1]).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(a[1], 1, 3))).cast("string"))
    digits = F.regexp_replace(a[7], "[^0-9]", "")
    offset = F.when(a[7].rlike("^[+-]"), F.concat(F.substring(a[7], 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0"))).otherwise("+00:00")
    text = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(a[2]), F.lit("T"), two(a[3]), F.lit(":"), two(a[4]), F.lit(":"), two(a[5]), F.lit("."), F.rpad(a[6], 6, "0"), offset)
    return F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")))


def etag_value(etag: Column) -> Column:
    """The tag an ETag header names, without weakness mark and quotes; null where empty."""
    bare = F.regexp_replace(F.trim(etag), r'^[wW]/', "")
    bare = F.trim(F.regexp_replace(F.trim(bare), r'^"|"$', ""))
    return F.when(bare != "", bare)

"""Dates the way boards write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import text_or_blank

_RFC = r"^(?:[A-Za-z]{3},\s*)?([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{4})\s+([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\s*(.*)$"


def local_wall_to_utc(ts, zone: str = fixed.BOARD_TIME_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def _in_bounds(ts: Column, now: Column) -> Column:
    low = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return F.when((ts >= low) & (ts <= now + F.expr("INTERVAL 1 DAY")), ts)


def _real_day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(
        F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")
    )


def _month_number(name: Column) -> Column:
    number = F.array_position(F.array(*[F.lit(m) for m in fixed.SHORT_MONTHS]), F.lower(name))
    return F.when(number > 0, number.cast("string"))


def normalize_stamp(c, now: Column) -> Column:
    """ISO, RFC 2822, unix seconds or milliseconds, or "HH:MM DD.MM.YYYY" in the board's zone -> instant.

    Days the calendar does not have, stamps before 2000 and stamps more than a day ahead are NULL.
    """
    s = F.trim(text_or_blank(c))
    number = F.when(s.rlike(r"^[0-9]{1,16}(\.[0-9]+)?$"), s.cast("double"))
    # milliseconds of years that a timestamp can hold; more is no stamp
    millis = F.when(number < 1e11, number * 1000).when(number < 1e14, number)
    unix = F.timestamp_millis(millis.cast("bigint"))
    board = F.when(
        s.rlike(r"^[0-9]{2}:[0-9]{2} [0-9]{2}\.[0-9]{2}\.[0-9]{4}$"),
        local_wall_to_utc(F.try_to_timestamp(s, F.lit("HH:mm dd.MM.yyyy"))),
    )
    iso_day = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:$|[T ])", 1)
    iso = F.when(F.try_to_timestamp(F.nullif(iso_day, F.lit("")), F.lit("yyyy-MM-dd")).isNotNull(), F.try_to_timestamp(s))
    day, month = F.regexp_extract(s, _RFC, 1), _month_number(F.regexp_extract(s, _RFC, 2))
    year, clock, zone = (F.regexp_extract(s, _RFC, i) for i in (3, 4, 5))
    offset = (
        F.when(zone.isin("GMT", "UTC", "UT", "Z", ""), "+00:00")
        .when(zone.rlike(r"^[+-][0-9]{4}$"), F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2))))
    )
    rfc = F.when(
        (day != "") & _real_day(year, month, day).isNotNull(),
        F.try_to_timestamp(F.concat(
            year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "),
            F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).when(clock == "", "00:00:00").otherwise(clock),
            offset,
        )),
    )
    return _in_bounds(F.coalesce(F.when(number.isNotNull(), unix), board, iso, rfc), now)


def month_name_date(c, now: Column, zone: str = fixed.BOARD_TIME_ZONE) -> Column:
    """"Published 9 March[ 2025]" -> that local midnight; without a year, the latest one not in the future."""
    pattern = r"(?iu)(?:Опубліковано|Published)\s+([0-9]{1,2})\s+(\p{L}+)(?:\s+([0-9]{4}))?"
    s = text_or_blank(c)
    names = F.create_map(*[F.lit(v) for pair in fixed.MONTHS.items() for v in (pair[0], str(pair[1]))])
    day = F.regexp_extract(s, pattern, 1)
    month = F.try_element_at(names, F.lower(F.regexp_extract(s, pattern, 2)))
    stated = F.nullif(F.regexp_extract(s, pattern, 3), F.lit(""))

    def on(year: Column) -> Column:
        return _in_bounds(F.to_utc_timestamp(_real_day(year, month, day), zone), now)

    this_year = F.year(F.from_utc_timestamp(now, zone))
    return F.when(stated.isNotNull(), on(stated)).otherwise(
        F.coalesce(on(this_year.cast("string")), on((this_year - 1).cast("string")))
    )


_AGE_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def relative_age(c, now: Column, zone: str = "UTC") -> Column:
    """struct(kind, at) of "6 days ago"; ages of a day or more are that local day; "Reposted" is a re-listing."""
    s = text_or_blank(c)
    pattern = r"([0-9]+)\s+(minute|hour|day|week|month|year)s?\s+ago(?![a-zA-Z0-9_])"
    unit = F.regexp_extract(s, pattern, 2)
    seconds = F.try_element_at(F.create_map(*[F.lit(v) for p in _AGE_SECONDS.items() for v in p]), unit)
    told = F.regexp_extract(s, pattern, 1).try_cast("bigint")
    count = F.when(told <= F.floor(F.lit(60_000_000_000) / seconds), told)  # ages of up to about 1,900 years
    instant = F.timestamp_micros((F.unix_micros(now) - count * seconds * 1000000).cast("bigint"))
    local_day = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(instant, zone)), zone)
    at = F.when(seconds >= 86400, local_day).otherwise(instant)
    kind = F.when(s.rlike(r"(^|·)\s*Reposted(?![a-zA-Z0-9_])"), "relisted").otherwise("posted")
    return F.when(at.isNotNull(), F.struct(kind.alias("kind"), at.alias("at")))


def shown_date(posted="posted", relisted="relisted", updated="updated") -> Column:
    """The one date to show: the first posting date, else the re-listing, else the last update."""
    return F.coalesce(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("at")))
        for kind, c in zip(fixed.DATE_KINDS, (posted, relisted, updated))
    ])


def age_label(kind, at, now: Column, zone: str = "UTC") -> Column:
    """"posted today", "relisted 3 d ago", "updated 6 w ago" in local calendar days; weeks from 14 days."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    local = lambda ts: F.to_date(F.from_utc_timestamp(ts, zone))
    days = F.greatest(F.lit(0), F.datediff(local(now), local(at)))
    return (
        F.when(F.isnull(at), "")
        .when(days == 0, F.concat(kind, F.lit(" today")))
        .when(days < 14, F.concat(kind, F.lit(" "), days.cast("string"), F.lit(" d ago")))
        .otherwise(F.concat(kind, F.lit(" "), F.floor(days / 7).cast("string"), F.lit(" w ago")))
    )

"""Dates, weights and scores as Columns. `today` and population sizes are always parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hub types and their weights; other types weigh 1.
TYPE_BOOST = {
    "investor": 1.5, "board": 1.5, "company": 1.5, "event": 1.3, "cause": 1.3,
    "person": 1.3, "technology": 1.0, "topic": 1.0, "school": 0.8, "city": 0.5,
}
#: Ages in days and their recency, then older, unknown; sharers and boost of the reference score.
RECENCY, OLDER, UNKNOWN = ((365, 1.0), (1095, 0.6)), 0.3, 0.5
REF_SHARERS, REF_BOOST = 3, 1.5


def type_boost(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TYPE_BOOST.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(1.0))


def recency(day: Column, today: Column) -> Column:
    age = F.datediff(today, day)
    out = F.when(day.isNull(), UNKNOWN)
    for days, value in RECENCY:
        out = out.when(age <= days, value)
    return out.otherwise(OLDER)


def idf(people: Column, carriers: Column) -> Column:
    """max(0, ln(N / (1 + n)))."""
    return F.greatest(F.lit(0.0), F.log(people / (1 + carriers)))


def crossing_cost(weight: Column) -> Column:
    return 1 / (1 + weight)


def reference_score(people: Column) -> Column:
    return F.when(people < REF_SHARERS, 0.0).otherwise(F.log(people / REF_SHARERS) * REF_BOOST)


def score(raw: Column, ref: Column) -> Column:
    """0 to 100, rounded half to even; any worth over a reference of nothing is 100."""
    return F.when(raw <= 0, 0).when(ref <= 0, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.bround(100 * raw / ref)))).cast("int")


def clamp01(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def parse_date(c: Column) -> Column:
    """A date of the forms that feeds and archives use (unix seconds, 14 digits, ISO, y/m/d, day month year, mail dates), else null."""
    t = F.trim(c)
    unix = F.when(t.rlike("^[0-9]{10,11}$"), F.when(t.cast("long").between(1_000_000_001, 99_999_999_999), F.to_date(F.timestamp_seconds(t.cast("long")))))
    stamp = F.when(t.rlike("^[0-9]{14}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))))
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))))
    slash = F.when(t.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyy/M/d"))))
    named = F.regexp_extract(t, r"^(?:[A-Z][a-z]{2}, )?([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", 1)
    return F.coalesce(unix, stamp, iso, slash, F.when(named != "", F.to_date(F.try_to_timestamp(named, F.lit("d MMM yyyy")))))


def shown_number(c: Column) -> Column:
    """Four decimals, null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))


def shown_score(c: Column) -> Column:
    """No decimals, halves to the even number."""
    return F.bround(c, 0).cast("long").cast("string")


def shown_day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("undated"))

"""Formatting, rounding and small array statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmm(minutes: Column) -> Column:
    """Minutes after midnight as `HH:MM`."""
    m = minutes.cast("int")
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), m % 60)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def _swap(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def thousands(value: Column) -> Column:
    """Whole number with `.` between thousands."""
    return _swap(F.format_number(value.cast("double"), 0))


def locale_number(value: Column) -> Column:
    """`48.159` or `-7,73`: decimals only for values below 1000 that are not whole; a dash for NULL."""
    v = value.cast("double")
    whole = (v == F.floor(v)) | (F.abs(v) >= 1000)
    return F.when(v.isNull(), F.lit("—")).when(whole, thousands(v)).otherwise(_swap(F.format_number(v, 2)))


def evidence_number(value: Column) -> Column:
    """As `locale_number`, but decimals whenever the value is not whole, and `NULL` spelled out."""
    v = value.cast("double")
    return F.when(v.isNull(), F.lit("NULL")).when(v == F.floor(v), thousands(v)).otherwise(_swap(F.format_number(v, 2)))


def locale_number_text(value: float | None) -> str:
    """`locale_number` for a value the driver already holds (a rule parameter)."""
    if value is None:
        return "—"
    digits = 0 if float(value).is_integer() or abs(value) >= 1000 else 2
    return f"{value:,.{digits}f}".translate(str.maketrans(",.", ".,"))


def run_url(template: str, run_id: Column) -> Column:
    """`template` with `{run_id}` replaced by the percent-encoded run id; NULL without a template or an id."""
    if not template:
        return F.lit(None).cast("string")
    # url_encode follows form encoding: put back what percent-encoding writes differently.
    quoted = F.replace(F.replace(F.url_encode(run_id), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    quoted = F.replace(quoted, F.lit("%7E"), F.lit("~"))
    return F.when(F.length(run_id) > 0, F.replace(F.lit(template), F.lit("{run_id}"), quoted))


def fact_line(**named: Column) -> Column:
    """`name: value; name: value` of the values that are not NULL, in the order given; `_` in a name is a space."""
    return F.concat_ws("; ", *[F.concat(F.lit(name.replace("_", " ") + ": "), value.cast("string")) for name, value in named.items()])


def band(lo: Column, hi: Column) -> Column:
    """`lo to hi` of two texts; NULL if one is."""
    return F.concat(lo, F.lit(" to "), hi)


def array_median(values: Column) -> Column:
    """Median of a short numeric array."""
    ordered = F.sort_array(values)
    n = F.size(values)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def array_stddev(values: Column) -> Column:
    """Sample standard deviation of a short numeric array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def grade(days: Column) -> Column:
    """Bucket A to E of a number of days late."""
    # Upper bound of each grade.
    return (F.when(days <= 30, "A").when(days <= 60, "B").when(days <= 90, "C").when(days <= 180, "D").otherwise("E"))

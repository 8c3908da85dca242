"""How a CSV file is written: delimiter, quote, decimal comma and date order, found from its first lines and then kept."""

from __future__ import annotations

import csv
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines looked at, and characters of each: a fixed amount, whatever the file.
LINES, CHARACTERS = 200, 20_000
DELIMITERS, QUOTES = (",", ";", "\t", "|"), ('"', "'")
_COMMA_NUMBER = re.compile(r"[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?")
_DAY = re.compile(r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})")


@dataclass(frozen=True)
class Dialect:
    """`numbers`: columns with a comma before the decimals; `dates`: columns and the pattern of their days."""

    delimiter: str = ","
    quote: str = '"'
    numbers: frozenset[str] = frozenset()
    dates: dict[str, str] = field(default_factory=dict)

    @property
    def converted(self) -> set[str]:
        return {*self.numbers, *self.dates}

    def value(self, column: str, kind: T.DataType) -> Column:
        """A converted column from its text; what doesn't fit is NULL."""
        name = F.col(f"`{column}`")
        if column in self.numbers:
            return F.replace(F.replace(F.trim(name), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)
        return F.try_to_timestamp(F.trim(name), F.lit(self.dates[column])).cast(kind)


def _fields(lines: list[str], delimiter: str, quote: str) -> list[list[str]]:
    return list(csv.reader(lines, delimiter=delimiter, quotechar=quote))


def _date_pattern(values: list[str], semicolon: bool) -> str | None:
    """The pattern of days written with figures; which comes first, day or month, by a figure above 12, else by the delimiter's custom."""
    parts = [_DAY.fullmatch(v) for v in values]
    if not values or not all(parts) or len({p[2] for p in parts}) > 1:
        return None
    first, second = max(int(p[1]) for p in parts), max(int(p[3]) for p in parts)
    if first > 31 or second > 31 or (first > 12 and second > 12):
        return None
    day_first = first > 12 or (second <= 12 and semicolon)
    return (parts[0][2]).join(["d", "M", "yyyy"] if day_first else ["M", "d", "yyyy"])


def dialect_of(lines: list[str]) -> Dialect:
    """The dialect whose lines agree best: the largest share of lines with as many fields as most have, then the most fields."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return Dialect()
    best, found = (0.0, 1), Dialect()
    for delimiter in DELIMITERS:
        for quote in QUOTES:
            sizes = Counter(map(len, _fields(lines, delimiter, quote)))
            width, times = max(sizes.items(), key=lambda s: (s[1], s[0]))
            if width > 1 and (times / len(lines), width) > best and len(_fields(lines[:1], delimiter, quote)[0]) == width:
                best, found = (times / len(lines), width), Dialect(delimiter, quote)
    rows = _fields(lines, found.delimiter, found.quote)
    numbers, dates = set(), {}
    for i, name in enumerate(rows[0]):
        values = [r[i].strip() for r in rows[1:] if len(r) == len(rows[0]) and r[i].strip()]
        if any("," in v for v in values) and all(_COMMA_NUMBER.fullmatch(v) for v in values):
            numbers.add(name)
        elif pattern := _date_pattern(values, found.delimiter != ","):
            dates[name] = pattern
    return Dialect(found.delimiter, found.quote, frozenset(numbers), dates)


def sniff(spark: SparkSession, path: str) -> Dialect:
    """The dialect of a file, or of a folder of files, from its first lines."""
    lines = spark.read.text(path).select(F.substring("value", 1, CHARACTERS).alias("v")).limit(LINES).collect()
    return dialect_of([r["v"] for r in lines])


def read_dialect(spark: SparkSession, path: str, dialect: Dialect, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a CSV file with a header. Without a schema the types are inferred."""
    reader = spark.read.option("header", True).option("sep", dialect.delimiter).option("quote", dialect.quote)
    if schema is None:
        raw = reader.option("inferSchema", True).csv(path)
    else:
        raw = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in dialect.converted else f for f in schema.fields])).csv(path)

    def kind(f: T.StructField) -> T.DataType:
        return schema[f.name].dataType if schema is not None else T.DoubleType() if f.name in dialect.numbers else T.DateType()

    return raw.select(*[dialect.value(f.name, kind(f)).alias(f.name) if f.name in dialect.converted else F.col(f"`{f.name}`") for f in raw.schema.fields])

"""Column expressions shared by all operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Date layouts tried, in this order, after the ISO forms.
DATE_LAYOUTS = ("MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd")
# The period kinds a token may name.
PERIOD_KINDS = ("month", "week", "dayofweek")
_TOKEN = re.compile(rf"^({'|'.join(PERIOD_KINDS)})_of:(.+)$")


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, FLOATING)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, FLOATING + INTEGRAL)


def is_correlatable(t: T.DataType) -> bool:
    return is_number(t) or isinstance(t, T.BooleanType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, TEMPORAL)


def is_sortable_axis(t: T.DataType) -> bool:
    return is_number(t) or is_temporal(t)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL mean the same thing here: missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def keyed_hash(seed: int | str, *keys: Column | str) -> Column:
    """32 random bits that depend only on the seed and the key, never on the partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def parse_time(c: Column) -> Column:
    """A timestamp from text in any of the accepted layouts, else NULL."""
    return F.coalesce(F.try_to_timestamp(c),
                      *[F.try_to_timestamp(c, F.lit(layout)) for layout in DATE_LAYOUTS])


def time_axis(df: DataFrame, name: str) -> Column:
    """The column itself when it sorts as time or number, else its text parsed as a timestamp."""
    c = F.col(f"`{name}`")
    return c if is_sortable_axis(col_type(df, name)) else parse_time(c.cast("string"))


def ordinal_time(df: DataFrame, name: str) -> Column:
    """The time axis as a number that sorts the same way (microseconds, or the number itself)."""
    t = col_type(df, name)
    c = F.col(f"`{name}`")
    if is_number(t):
        return c.cast("double") if is_floating(t) else c.cast("bigint")
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("bigint")
    return F.unix_micros(c if isinstance(t, T.TimestampType) else parse_time(c.cast("string")))


def split_token(token: str) -> tuple[str, str] | None:
    """``month_of:ts`` -> ``("month", "ts")``; None when the text is not a period token."""
    m = _TOKEN.match(token or "")
    return (m.group(1), m.group(2)) if m else None


def period_expr(df: DataFrame, period: str) -> Column:
    """A period column: a real column by name, or one derived from a period token."""
    parts = split_token(period)
    if parts is None:
        return F.col(f"`{period}`")
    kind, source = parts
    t = time_axis(df, source)
    if kind == "month":
        return F.month(t).cast("bigint")
    if kind == "week":
        return F.weekofyear(t).cast("bigint")
    return F.weekday(t).cast("bigint")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)

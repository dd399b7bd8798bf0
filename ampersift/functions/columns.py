"""Column expressions: missing values, time grains, vectors, division."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_SECOND = 1_000_000


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> Column:
    """A column whose name may hold dots, percent or currency signs."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({n: F.when(~F.isnan(quoted(n)), quoted(n)) for n in floats})


def is_missing(df: DataFrame, name: str) -> Column:
    """True for NULL, and for NaN where the type has one."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def known(value: str | Column) -> Column:
    """A number as double, NULL where it is missing."""
    v = as_col(value).cast("double")
    return F.when(~F.isnan(v), v)


def at_grain(ts: str | Column, unit: str) -> Column:
    """Start of the enclosing hour, day, ... as a zone-less timestamp."""
    return F.date_trunc(unit, as_col(ts)).cast(T.TimestampNTZType())


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch as a long (UTC session)."""
    return F.unix_micros(as_col(ts).cast(T.TimestampType()))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast(T.TimestampNTZType())


def epoch_seconds(ts: str | Column) -> Column:
    return micros(ts) / F.lit(MICROS_PER_SECOND)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL instead of an ANSI error on a zero divisor."""
    return F.try_divide(top, bottom)


def clip_low(value: Column, floor: float) -> Column:
    """``max(value, floor)`` that keeps missing values missing."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def scale_by(value: Column, centre: Column, spread: Column) -> Column:
    """``(value - centre) / spread`` where a zero spread counts as one."""
    return (value - centre) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(ratio(dot(a, b), norms))


def similarity(distance: Column) -> Column:
    """Retrieval score of a squared distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that several later expressions read.

    A plain projection may be inlined into every reader, filters included, and
    then runs once per reader. A one-row generator is not inlined.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline_outer(packed))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

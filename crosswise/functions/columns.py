"""Column-level helpers shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve panel features and whether larger is favourable.
FEATURE_DIRECTIONS = {
    "return_1w": 1,
    "return_4w": 1,
    "return_13w": 1,
    "return_26w": 1,
    "momentum_12_1": 1,
    "volatility_20d": -1,
    "volatility_60d": -1,
    "price_to_sma20": 1,
    "price_to_sma60": 1,
    "bollinger_z20": 1,
    "rsi14_simple": -1,
    "close_to_high252": 1,
}


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL, so ranks and aggregates ignore them."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def finite_sql(name: str) -> str:
    """The same as SQL text, for expressions built as strings."""
    return f"if(isnan({name}) or abs({name}) = double('infinity'), null, {name})"


def clean_ticker(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.upper(F.trim(c.cast("string")))


def ticker_key(value: Column | str) -> Column:
    """Key used only to match share-class spellings such as BRK.B and BRK-B."""
    return F.translate(clean_ticker(value), ".", "-")


def epoch_or_date(value: Column | str) -> Column:
    """Parse a date that may arrive as a date, a timestamp, an ISO string or
    nanoseconds since the epoch (as an integer or as digits in a string)."""
    text = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    nanos = text.rlike(r"^-?\d{16,19}$")
    # The cast sits inside the branch so that ISO text never reaches it (ANSI mode).
    from_epoch = F.to_date(
        F.timestamp_micros(F.floor(F.try_to_number(text, F.lit("S9999999999999999999")) / 1000).cast("long"))
    )
    return F.when(nanos, from_epoch).otherwise(F.to_date(F.substring(text, 1, 10)))


def wednesday_on_or_after(day: Column) -> Column:
    return F.date_add(day, (F.lit(9) - F.weekday(day)) % 7)


def close_to(a: Column, b: Column, rtol: float = 1e-8, atol: float = 1e-10) -> Column:
    """Tolerance comparison in which two missing values are equal."""
    both = a.isNull() & b.isNull()
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return both | F.coalesce(near, F.lit(False))

"""Money as decimals: exact sums, half-even rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_cents(cents: Column) -> Column:
    return (cents.cast("long") / F.lit(100.0)).cast("decimal(12,2)")


def total(amount: Column) -> Column:
    """An exact sum of decimals, as a double."""
    return F.sum(amount).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def round_half_even(value: Column, scale: int, precision: int = 19) -> Column:
    return F.bround(value.cast(f"decimal(38,{scale + 8})"), scale).cast(f"decimal({precision},{scale})")

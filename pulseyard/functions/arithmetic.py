"""Integer and rounding helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_half_even(part: Column, total: Column) -> Column:
    """``part`` as a whole percentage of ``total``, halves to even, a total below 1 taken as 1."""
    share = part.cast("double") / F.greatest(total, F.lit(1)).cast("double")
    return F.rint(share * 100).cast("bigint")


def ceil_div(numerator: Column, denominator: Column) -> Column:
    """Smallest integer not below the ratio, in integer arithmetic at any size."""
    whole = F.call_function("div", numerator, denominator)
    above = (numerator % denominator != 0) & ((numerator > 0) == (denominator > 0))
    return (whole + above.cast("bigint")).cast("bigint")


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above an integer."""
    return value - F.pmod(value, F.lit(step))


def mask16(value: Column) -> Column:
    """Lowest 16 bits, so -1 gives 65535 and 65536 gives 0."""
    return value.bitwiseAND(F.lit(0xFFFF))

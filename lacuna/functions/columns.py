"""Small column expressions: coercion, rounding, deterministic uniforms."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 12
HASH_SPAN = float(16**HASH_DIGITS)


def as_number(column: Column) -> Column:
    """Numeric value or NULL; text that is no number, NaN and +-inf become NULL."""
    number = column.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), None).otherwise(number)


def clip(column: Column, low, high) -> Column:
    """Clip to [low, high]; NULL stays NULL (least/greatest alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def hash_digits(*parts) -> Column:
    """md5 over the parts joined with '|'."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_number(*parts) -> Column:
    """First 48 bits of :func:`hash_digits` as a long."""
    return F.conv(F.substring(hash_digits(*parts), 1, HASH_DIGITS), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Uniform in the open interval (0, 1); a pure function of the parts, so it does
    not depend on partitioning, retries or row order."""
    return (hash_number(*parts).cast("double") + F.lit(0.5)) / F.lit(HASH_SPAN)


def hash_reaches(digits: Column, bound: float) -> Column:
    """Whether the uniform of the parts whose md5 is ``digits`` is at least ``bound``, by comparing the digits: the same
    as ``hash_uniform(*parts) >= bound`` without making a number of them."""
    least = math.ceil(Fraction(bound) * 16**HASH_DIGITS - Fraction(1, 2))
    if least >= 16**HASH_DIGITS:
        return F.lit(False)
    return digits >= F.lit(format(max(least, 0), f"0{HASH_DIGITS}x"))


def hash_uniform_value(*parts) -> float:
    """Driver-side twin of :func:`hash_uniform` for the few model coefficients."""
    text = "|".join(str(p) for p in parts)
    return (int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16) + 0.5) / HASH_SPAN


def hash_normal_value(*parts) -> float:
    """Standard normal by Box-Muller over two hashed uniforms."""
    first = hash_uniform_value(*parts, "radius")
    second = hash_uniform_value(*parts, "angle")
    return math.sqrt(-2.0 * math.log(first)) * math.cos(2.0 * math.pi * second)


def nearest_level(value: Column, levels: list[float]) -> Column:
    """Closest of ``levels``; a tie goes to the lower level, NULL stays NULL."""
    if not levels:
        return value
    ordered = sorted(float(v) for v in levels)
    snapped = F.lit(ordered[-1])
    for low, high in reversed(list(zip(ordered, ordered[1:]))):
        snapped = F.when(F.abs(value - low) <= F.abs(value - high), F.lit(low)).otherwise(snapped)
    return F.when(value.isNotNull(), snapped)


def label_map(column: Column, mapping: dict) -> Column:
    """Replace by a literal map; values absent from the map stay as they are."""
    if not mapping:
        return column
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)

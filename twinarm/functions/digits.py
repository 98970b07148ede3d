"""Doubles in decimal digits, exactly: binary fractions expanded in decimal columns, as C's printf does. Java's own formats start from the shortest digits that tell a double apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a half, bits of a fraction that are expanded (exact for doubles from 2**-30 on), and how they are read out of the double.
_HALF, _BITS, _HIGH = 8, 83, 30
_UNIT = 1 << _BITS


def _decimal(value: Column | int, digits: int) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast(f"decimal({digits},0)")


def fixed16(x: Column) -> Column:
    """``%.16f`` of doubles from 0 up to 2**53: the exact value, rounded half to even at the sixteenth decimal. NaN gives ``nan``."""
    whole = F.floor(x)
    scaled = (x - whole) * F.lit(float(1 << _HIGH))
    high = F.floor(scaled)
    low = F.floor((scaled - high) * F.lit(float(1 << (_BITS - _HIGH))))
    n = _decimal(_decimal(high, 10) * _decimal(1 << (_BITS - _HIGH), 17) + _decimal(low, 17), 26)

    def digits(rest: Column) -> tuple[Column, Column]:
        """The next eight digits of rest / _UNIT, and what is left."""
        more = _decimal(rest, 26) * _decimal(10**_HALF, 9)
        q = F.call_function("div", more, _decimal(_UNIT, 25))
        return q, more - _decimal(q, 9) * _decimal(_UNIT, 25)

    first, left = digits(n)
    second, left = digits(left)
    twice = _decimal(left, 26) * _decimal(2, 1)
    up = (twice > _decimal(_UNIT, 25)) | ((twice == _decimal(_UNIT, 25)) & (second % 2 == 1))
    all_digits = first * F.lit(10**_HALF) + second + up.cast("bigint")
    carried = all_digits == F.lit(10 ** (2 * _HALF))
    shown = F.concat((whole + carried.cast("bigint")).cast("string"), F.lit("."), F.lpad(F.when(carried, F.lit(0).cast("bigint")).otherwise(all_digits).cast("string"), 2 * _HALF, "0"))
    return F.when(F.isnan(x) | x.isNull(), "nan").otherwise(shown)

"""Numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(v: Column) -> Column:
    """A number in six significant digits without trailing zeros, as ``%g`` writes it: with an exponent below 1e-4 and from 1e6 on."""
    size = F.abs(v)
    raw = F.floor(F.log10(size)).cast("int")
    # the double nearest to a decimal text, so that a scale below 1 loses nothing
    mantissa = F.bround(F.when(raw < 0, size * F.pow(F.lit(10.0), -raw)).otherwise(size / F.pow(F.lit(10.0), raw)), 5)
    exponent = F.when(mantissa >= 10, raw + 1).otherwise(raw)
    mantissa = F.when(mantissa >= 10, mantissa / 10).otherwise(mantissa)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(size)))
    plain = bare((F.round(size * scale) / scale).cast("decimal(38,12)").cast("string"))
    far = F.concat(bare(mantissa.cast("decimal(12,5)").cast("string")), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    far = F.when(F.abs(exponent) > 99, F.concat(F.regexp_extract(far, "^(.*e.)", 1), F.abs(exponent).cast("string"))).otherwise(far)
    text = F.when((exponent < -4) | (exponent >= 6), far).otherwise(plain)
    return F.when(v == 0, "0").when(F.isnan(v), "nan").when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(F.when(v < 0, F.concat(F.lit("-"), text)).otherwise(text))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digits_within(value: Column, text: Column) -> Column:
    """Whether the digits of a value occur in those of a text; true for a value without digits. 6 occurs in 60."""
    return F.contains(digits(F.coalesce(text, F.lit(""))), digits(six_digits(value)))


def to_number(c: Column) -> Column:
    """Decimal value of a text, null where it is none."""
    return F.trim(c).try_cast("decimal(38,10)")


def truthy(c: Column) -> Column:
    return F.lower(c).isin("true", "t", "yes", "ja")


def text_forms(v: Column) -> Column:
    """The forms in which a number may stand in a text: with a point and with a comma."""
    g = six_digits(v)
    return F.array_distinct(F.array(g, F.replace(g, F.lit("."), F.lit(","))))

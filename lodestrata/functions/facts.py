"""Values of quoted facts, and how numbers and ratios are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.constants import FACT_UNITS


def fact_value(value: Column, unit: Column) -> Column:
    """A quoted value in millions; null without a value or in another unit."""
    factor = F.lit(None).cast("double")
    for name, by in FACT_UNITS.items():
        factor = F.when(unit == name, F.lit(by)).otherwise(factor)
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double") * factor


def number_text(value: Column) -> Column:
    """With separators; two decimals unless the value is whole."""
    return F.when(value == F.bround(value, 0), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def ratio_text(value: Column) -> Column:
    """10.0× from one up, 0.12% below a hundredth, else 63.5%."""
    plain = lambda v, digits: F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))
    return (
        F.when(value >= 1, F.concat(plain(value, 1), F.lit("×")))
        .when(value < 0.01, F.concat(plain(100 * value, 2), F.lit("%")))
        .otherwise(F.concat(plain(100 * value, 1), F.lit("%")))
    )

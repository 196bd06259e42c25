"""Column expressions: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwright.config import CATEGORY_ORDER

TICKS_PER_POINT = 1e9


def ticks(column: Column) -> Column:
    """Percentage as a whole number of 1e-9 steps.

    Values and thresholds are compared on this grid: an average of equal goals
    can be one unit in the last place off, which would flip ``value >= goal``.
    """
    return F.floor(column * F.lit(TICKS_PER_POINT) + F.lit(0.5))


def round_half_up(column: Column, places: int) -> Column:
    """Round by the decimal value, so 23/40 gives 0.58 and not 0.57."""
    return F.round(column.cast("decimal(20,9)"), places).cast("double")


def band_flags(value: Column, cuts: list[Column]) -> list[Column]:
    """One condition per band; ``cuts`` are the lower ends of bands 2 to 5.

    Each band is tested on its own: where a model's cuts are out of order the
    bands overlap and a value counts in more than one.
    """
    low, *rest = cuts
    flags = [value < low]
    for lower, upper in zip(cuts, rest):
        flags.append((value >= lower) & (value < upper))
    flags.append(value >= cuts[-1])
    return flags


def first_level(value: Column, cuts: list[Column]) -> Column:
    """Number of the first band that holds the value; null without cuts."""
    return F.coalesce(
        *(
            F.when(flag, F.lit(number))
            for number, flag in enumerate(band_flags(value, cuts), start=1)
        )
    )


def label_of(column: Column, labels: Mapping[object, str]) -> Column:
    """Code to label; a code without a label gives null."""
    return F.coalesce(
        *(F.when(column == F.lit(code), F.lit(text)) for code, text in labels.items()),
        F.lit(None).cast("string"),
    )


def indicator_category(indicator: Column, prefix: str = "Persistence ") -> Column:
    return F.replace(indicator, F.lit(prefix), F.lit(""))


def category_ordinal(category: Column) -> Column:
    """PK is -1, K is 0, numbers stand for themselves, anything else is null.

    PK is replaced first: the other way round it would become ``P0``.
    """
    digits = F.replace(F.replace(category, F.lit("PK"), F.lit("-1")), F.lit("K"), F.lit("0"))
    return digits.try_cast("int")


def category_rank(category: Column, order: Iterable[str] = CATEGORY_ORDER) -> Column:
    """Place in the display order; null for a category outside it."""
    position = F.array_position(F.array(*(F.lit(c) for c in order)), category)
    return F.nullif(position, F.lit(0)).cast("int")


def percent_text(share: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", share * F.lit(100.0))

from bandwright.functions.columns import (
    TICKS_PER_POINT,
    band_flags,
    category_ordinal,
    category_rank,
    first_level,
    indicator_category,
    label_of,
    percent_text,
    round_half_up,
    ticks,
)
from bandwright.functions.names import parse_grain_label, snake_case, title_case

__all__ = [
    "TICKS_PER_POINT",
    "band_flags",
    "category_ordinal",
    "category_rank",
    "first_level",
    "indicator_category",
    "label_of",
    "parse_grain_label",
    "percent_text",
    "round_half_up",
    "snake_case",
    "ticks",
    "title_case",
]

"""Names, labels and constants shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("period", "measure_type", "region", "unit", "category")
LEVELS = ("level_1", "level_2", "level_3", "level_4", "level_5")
BANDS = (1, 2, 3, 4, 5)
STATS = ("goal", "percent_met", "mean", "min", "max", "median", "sd")

# Sides of the goal; a value that reaches it is above.
BELOW, ABOVE = "below", "above"

# An observation below this percentage is left out (inclusive floor).
VALUE_FLOOR = 50.0


@dataclass(frozen=True)
class Grain:
    """One aggregation level: which keys it groups by and how it is shown."""

    keys: tuple[str, ...]
    label: str
    display: str

    @property
    def id(self) -> int:
        """Bit per absent key, as ``grouping(region, unit, category)`` gives it."""
        return sum(bit for key, bit in GRAIN_BITS if key not in self.keys)


GRAIN_BITS = (("region", 4), ("unit", 2), ("category", 1))

# Grain labels and display names of the published tables.
GRAINS = (
    Grain(
        ("period", "measure_type", "region", "unit"),
        "academic_year | persistence_type | region | campus",
        "Campuses",
    ),
    Grain(
        ("period", "measure_type", "region", "category"),
        "academic_year | persistence_type | region | grade",
        "Regional and Grade Level",
    ),
    Grain(
        ("period", "measure_type", "category"),
        "academic_year | persistence_type | grade",
        "Grade Level",
    ),
    Grain(
        ("period", "measure_type", "region"),
        "academic_year | persistence_type | region",
        "Regional",
    ),
    Grain(
        ("period", "measure_type"),
        "academic_year | persistence_type",
        "Org-wide",
    ),
)

# Model names of the published tables.
MODEL_GOAL_SD = "Level 2/4/5 Goal +/- SPR SD"
MODEL_MEAN_SD = "Level 2/4/5 Avg SPR +/- SPR SD"
MODEL_KMEANS = "Level 2/4/5 K means"

# Published column name for each neutral name used in this code.
PUBLISHED_NAMES = {
    "period": "academic_year",
    "measure_type": "persistence_type",
    "measure_display": "persistence_type_display",
    "unit": "campus",
    "category": "grade",
    "value": "persistence",
    "grain": "grouped_by",
    "grain_display": "grouped_by_display",
    "mean": "persistence_mean",
    "min": "persistence_min",
    "max": "persistence_max",
    "median": "persistence_median",
    "sd": "persistence_sd",
}

# Display order of the categories; others sort last.
CATEGORY_ORDER = ("PK", "K", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11")

# Growth target by tier, and the goal of units exempt from growth.
GROWTH_TARGETS = {"1": "6.5", "2": "4", "3": "2", "4": "1", "exempt": "maintain"}
EXEMPT_TIER = "exempt"
EXEMPT_GOAL = 90.0


@dataclass(frozen=True)
class Measure:
    """How one measure's raw results become percentages worth scoring."""

    name: str
    display: str
    scale: float = 1.0
    excluded_category_ids: tuple[int, ...] = field(default=())


# The two published measures, their labels and their exclusions.
SCHOOL_MEASURES = (
    Measure("FDOP", "First Day of Persistience", 100.0, (12,)),
    Measure("LDOS", "Last Day of School"),
)

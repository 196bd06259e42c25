"""Column-name helpers; they work on the schema, never on rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame


def snake_case(names: Iterable[str]) -> list[str]:
    """Normalise headers: ASCII, lower snake case, unique, never digit-first."""
    result: list[str] = []
    for name in names:
        text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        text = re.sub(r"['\"]", "", text)
        text = text.replace("%", "_percent_").replace("#", "_number_")
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = "x" + text
        unique, copy = text, 2
        while unique in result:
            unique, copy = f"{text}_{copy}", copy + 1
        result.append(unique)
    return result


def title_case(names: Iterable[str]) -> list[str]:
    return [" ".join(word.capitalize() for word in name.split("_") if word) for name in names]


def parse_grain_label(label: str, leading: str = "academic_year") -> list[str]:
    """Column names a grain label stands for, without the leading period."""
    rest = re.sub(rf"^{re.escape(leading)} \| ", "", label)
    return rest.replace(" ", "").split("|")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_case(df.columns))


def title_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*title_case(df.columns))

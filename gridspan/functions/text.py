"""Names made of numbers, and numbers read back from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_code(t: Column) -> Column:
    """28.5 as ``28p5``: a threshold as part of a column's name."""
    return F.replace(t.cast("string"), F.lit("."), F.lit("p"))


def code_of(t: float) -> str:
    """The same for a plain number."""
    return str(float(t)).replace(".", "p")


def threshold_of(code: str) -> float:
    """28.5 from ``28p5``."""
    return float(code.lower().replace("p", "."))

"""Report formatting (three decimals, as the selection report prints them)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_text(c: Column, decimals: int = 3) -> Column:
    return F.format_string(f"%.{decimals}f", c.cast("double"))

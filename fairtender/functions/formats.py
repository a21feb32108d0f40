"""Printed numbers of the result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, decimals: int = 3) -> Column:
    """Fixed decimals, without grouping; a tie in the printed decimal goes away from zero."""
    return F.format_string(f"%.{decimals}f", value.cast("double"))


def stars(p_value: Column) -> Column:
    """One star each at 0.1, 0.05 and 0.01."""
    count = sum(F.coalesce((p_value <= F.lit(limit)).cast("int"), F.lit(0)) for limit in (0.1, 0.05, 0.01))
    return F.repeat(F.lit("*"), count)


def estimate_text(coef: Column, p_value: Column, decimals: int = 3) -> Column:
    """``1.234**``; an omitted term (missing or 0) is ``- -``."""
    shown = F.concat(fixed(coef, decimals), stars(p_value))
    return F.when(F.coalesce(coef, F.lit(0.0)) != 0, shown).otherwise("- -")


def error_text(coef: Column, stderr: Column, decimals: int = 3) -> Column:
    """``(0.123)``, blank for an omitted term."""
    shown = F.concat(F.lit("("), fixed(stderr, decimals), F.lit(")"))
    return F.when(F.coalesce(coef, F.lit(0.0)) != 0, shown).otherwise("")

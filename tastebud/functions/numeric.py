"""Numeric helpers: reproducible uniforms, rounding, guarded division, age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 6  # one rounding rule for every reported double


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), SCALE)


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A uniform in [0, 1) from md5(seed | keys): same value on any partitioning.

    numpy's generator streams cannot be reproduced across engines, so draws are
    a pure function of the seed and the row key instead.
    """
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num/den, ``default`` when den is 0 or null (ANSI mode raises otherwise)."""
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(num / den)


def age_band(age: Column | str) -> Column:
    """null/NaN -> unknown, <25 -> 16-24, <35 -> 25-34, <50 -> 35-49, else 50+."""
    a = F.col(age) if isinstance(age, str) else age
    a = a.cast("double")
    return (F.when(a.isNull() | F.isnan(a), F.lit("unknown"))
            .when(a < 25, F.lit("16-24"))
            .when(a < 35, F.lit("25-34"))
            .when(a < 50, F.lit("35-49"))
            .otherwise(F.lit("50+")))

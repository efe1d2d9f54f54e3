"""Fixed-point arithmetic on columns.

Scores, rates and weights are decimals with a stated number of places, computed
from integers and rounded half up.  Results then do not depend on the order in
which partitions are summed, and agree bit for bit between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(num: Column, den: Column | int, scale: int = 0, wide: bool = False) -> Column:
    """``num / den`` as whole units of ``10**-scale``, rounded half up.

    ``num`` must not be negative.  NULL where ``den`` is 0.  ``wide`` does the
    intermediate product in DECIMAL, for money totals that could leave LONG.
    """
    den = den if isinstance(den, Column) else F.lit(den)
    kind = "decimal(24,0)" if wide else "bigint"
    n, d = num.cast(kind), F.nullif(den.cast(kind), F.lit(0).cast(kind))
    unit = F.lit(2 * 10**scale).cast("decimal(12,0)" if wide else "bigint")
    two = F.lit(2).cast("decimal(1,0)" if wide else "bigint")
    return F.call_function("div", n * unit + d, d * two)


def scaled(units: Column, scale: int, precision: int = 9) -> Column:
    """Whole units of ``10**-scale`` as a decimal."""
    whole = units.cast(f"decimal({precision},0)")
    return (whole * F.lit(f"1e-{scale}").cast(f"decimal({scale},{scale})")).cast(
        f"decimal({precision},{scale})"
    )


def ratio(num: Column, den: Column | int, scale: int = 4, precision: int = 9, wide: bool = False) -> Column:
    """``num / den`` as a decimal with ``scale`` places, half up; NULL where ``den`` is 0."""
    return scaled(half_up(num, den, scale, wide), scale, precision)


def units(value: Column, scale: int = 4) -> Column:
    """A decimal as whole units of ``10**-scale``."""
    return (value * F.lit(10**scale)).cast("bigint")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def plain_number(value: Column) -> Column:
    """A number without trailing zeros: 3, 7.5."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def percent(num: Column, den: Column, wide: bool = False) -> Column:
    """Whole per cent, 0 where the denominator is 0."""
    return F.coalesce(half_up(num, den, 2, wide), F.lit(0))

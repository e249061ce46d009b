"""Numeric helpers and the score formulas built on them."""

from pyspark.sql import Column, functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def capped_ratio(x: Column, cap: float) -> Column:
    """``x / cap``, at most 1."""
    return F.least(x.cast("double") / F.lit(float(cap)), F.lit(1.0))


def guarded_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with the divisor raised to at least 1."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def py_round(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled double, as numpy rounds.

    ``bround`` works on the printed digits instead and sees ties that the double does not have.
    """
    scale = F.lit(float(10 ** digits))
    return F.rint(x * scale) / scale


def whole_at_least_one(x: Column) -> Column:
    """Truncate towards zero, then raise to at least 1."""
    return F.greatest(x.cast("long"), F.lit(1).cast("long"))


def file_hotspot_score(complexity: Column, frequency: Column) -> Column:
    return (capped_ratio(complexity, 50) + capped_ratio(frequency, 20)) / 2


def file_risk_score(complexity: Column, frequency: Column) -> Column:
    return capped_ratio(complexity, 30) * 0.4 + capped_ratio(frequency, 15) * 0.6


def subsystem_hotspot_score(touches: Column, authors: Column, mean_files: Column) -> Column:
    """0.4 touch volume + 0.3 author count + 0.3 commit size, each capped; 0 without touches."""
    score = (capped_ratio(touches, 20) * 0.4 + capped_ratio(authors, 5) * 0.3
             + capped_ratio(mean_files, 10) * 0.3)
    return F.when(F.coalesce(touches, F.lit(0)) == 0, F.lit(0.0)).otherwise(score)


def change_impact(insertions: Column, deletions: Column, delta: Column, importance: Column) -> Column:
    return 0.4 * (insertions + deletions) + 0.3 * F.abs(delta) + 0.3 * importance


def score_band(score: Column) -> Column:
    """``good/green`` from 80, ``warning/yellow`` from 60, else ``critical/red``."""
    return (F.when(score >= 80, F.struct(F.lit("good").alias("band"), F.lit("green").alias("color")))
            .when(score >= 60, F.struct(F.lit("warning").alias("band"), F.lit("yellow").alias("color")))
            .otherwise(F.struct(F.lit("critical").alias("band"), F.lit("red").alias("color"))))

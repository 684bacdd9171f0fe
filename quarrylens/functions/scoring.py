"""Scores of snapshots against a baseline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(v: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """v within lo and hi; null stays null."""
    v = _c(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def delta_score(baseline: Column | str, current: Column | str) -> Column:
    """The share of the baseline that is gone; 1 where there was nothing."""
    b, c = _c(baseline), _c(current)
    return F.when(b <= 0, 1.0).otherwise(clamp(F.try_divide(b - c, b)))


def lint_score(baseline: Column | str, current: Column | str) -> tuple[Column, Column]:
    """Score and added violations."""
    return delta_score(baseline, current), F.greatest(F.lit(0), _c(current) - _c(baseline))


def symbol_score(baseline: Column | str, current: Column | str) -> tuple[Column, Column]:
    return delta_score(baseline, current), F.bround(F.greatest(F.lit(0.0), _c(current) - _c(baseline)), 0)


def style_score(baseline: Column | str, current: Column | str, violations: Column | str) -> Column:
    """Of a perfect baseline only no violation scores; a loss scores 0; else the share of what was left to gain."""
    b, c, n = _c(baseline), _c(current), _c(violations)
    return F.when(b >= 1, F.when(n == 0, 1.0).otherwise(0.0)).when(c < b, 0.0).otherwise(clamp((c - b) / F.greatest(1 - b, F.lit(0.01))))


def complexity_score(cc_base: Column | str, cc_now: Column | str, o_base: Column | str, o_now: Column | str, instead: Column | None = None) -> Column:
    """instead, where it isn't null, stands for the part of cyclomatic costs, as when the tool that measures them has failed."""
    cc = delta_score(cc_base, cc_now)
    cc = cc if instead is None else F.coalesce(instead, cc)
    return F.greatest(F.lit(0.01), clamp(0.55 * clamp(cc) + 0.45 * delta_score(o_base, o_now)))


def coverage_constraint(pass_rate: Column | str, coverage: Column | str, baseline: Column | str) -> Column:
    return _c(pass_rate) * F.when(_c(coverage) >= _c(baseline) - 0.02, 1.0).otherwise(0.5)


def coverage_objective(pass_rate: Column | str, coverage: Column | str, baseline: Column | str, target: Column | str) -> Column:
    return clamp((_c(coverage) - _c(baseline)) / F.greatest(_c(target) - _c(baseline), F.lit(0.01))) * _c(pass_rate)


def coverage_score(mode: Column | str, failed: Column, constraint: Column, objective: Column) -> Column:
    """0 where the run failed; the objective only where the mode says so."""
    return F.when(failed, 0.0).when(F.coalesce(_c(mode), F.lit("constraint")) == "objective", objective).otherwise(constraint)


def decay(steps: Column | str, max_steps: Column | str, rate: Column | str) -> Column:
    return F.greatest(F.lit(0.0), 1 - _c(steps) / _c(max_steps) * _c(rate))


def python_round(x: Column | str, digits: int) -> Column:
    """Half to even on the exact binary value, which no SQL function gives; for values that are rounded by contract, of
    which there are few. A batch at a time."""

    @F.pandas_udf(DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits), na_action="ignore")

    return rounded(_c(x).cast("double"))


def python_format(x: Column, digits: int) -> Column:
    """The number as text, rounded as python_round does; formats of SQL round half up on the digits that they show."""

    @F.pandas_udf(StringType())
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.{digits}f}" for v in values], dtype=object)

    return shown(x.cast("double"))

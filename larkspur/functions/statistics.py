"""Association statistics of 2 x 2 tables, as columns and as numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty. Doubles, as the product of margins overflows longs."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(below > 0, (tp * tn - fp * fn) / F.sqrt(below)).otherwise(0.0)


def chi_square(a_yes: Column, a_all: Column, b_yes: Column, b_all: Column) -> Column:
    """Pearson's statistic of two groups' rates; 0 (p = 1) where a row or an expected cell is empty."""
    a_yes, a_all, b_yes, b_all = (c.cast("double") for c in (a_yes, a_all, b_yes, b_all))
    n, yes = a_all + b_all, a_yes + b_yes
    no = n - yes
    usable = (a_all > 0) & (b_all > 0) & (yes > 0) & (no > 0)
    cross = a_yes * (b_all - b_yes) - b_yes * (a_all - a_yes)
    return F.when(usable, n * cross * cross / (a_all * b_all * yes * no)).otherwise(0.0)


#: Terms of the series, levels of the fraction, and where one follows the other.
_TERMS, _LEVELS, _FROM = 60, 40, 2.0


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, in column expressions; relative error below 1e-12.

    Below _FROM by the series of erf with positive terms only, 2 x exp(-x^2) / sqrt(pi) * sum of
    (2 x^2)^n / (1 * 3 * ... * (2 n + 1)); above by the continued fraction
    exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + (2/2) / (x + (3/2) / (x + ...)))), from its last level up.
    """
    levels = F.sequence(F.lit(_LEVELS), F.lit(1), F.lit(-1))
    terms = F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(levels, x, lambda below, k: x + k / 2.0 / below)
    series = F.aggregate(terms, F.lit(1.0), lambda behind, k: 1.0 + behind * 2.0 * x * x / (2.0 * k + 1.0))
    edge = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < _FROM, 1.0 - 2.0 * x * edge * series).otherwise(edge / fraction)


def p_values(chi2: Column) -> Column:
    """Upper tails at one degree of freedom; 1 for a statistic of 0."""
    return F.when(chi2 > 0, erfc(F.sqrt(chi2 / 2))).otherwise(1.0)


def p_value(chi2: float) -> float:
    """Upper tail at one degree of freedom."""
    return math.erfc(math.sqrt(chi2 / 2)) if chi2 > 0 else 1.0


def chi_square_cut(p: float) -> float:
    """The statistic whose p_value is ``p``, by bisection."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if p_value(middle) > p else (low, middle)
    return high

"""Tail probabilities of the paired tests, for tables of a few hundred tests."""

from __future__ import annotations

import math


def chi2_sf(statistic: float | None, df: int) -> float | None:
    """Upper tail of chi-square with integer degrees of freedom (finite sums)."""
    if statistic is None or math.isnan(statistic):
        return None
    half = statistic / 2.0
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5) if half > 0 else 0.0
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, total)


EXACT_LIMIT = 50


def signed_rank_p(statistic: float | None, n: int, tie_term: float, n_zero: int) -> float | None:
    """Two-sided p of ``W = min(W+, W-)``.

    Exact null distribution for up to 50 untied non-zero differences, otherwise the
    normal form with the tie correction and without continuity correction.
    """
    if statistic is None or n < 1:
        return None
    if n <= EXACT_LIMIT and tie_term == 0 and n_zero == 0:
        counts = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for total in range(len(counts) - 1, rank - 1, -1):
                counts[total] += counts[total - rank]
        below = sum(counts[: int(math.floor(statistic)) + 1])
        return min(1.0, 2.0 * below / 2.0**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0)
    if spread == 0:
        return 1.0
    return math.erfc(abs(statistic - n * (n + 1) / 4.0) / spread / math.sqrt(2.0))

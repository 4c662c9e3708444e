"""Labels and bands, each a single CASE expression (SQL text)."""

from __future__ import annotations

from tallyloom.functions.numeric import finite
from tallyloom.names import RATINGS, UNKNOWN

# Thresholds of the bands, in percentage points unless said otherwise.
ATTENTION_GAP = "5D"
STRONG_GAP = "2D"
MATERIAL_SHARE = "5D"

GOOD, FAIR, POOR = "Strong", "Average", "Needs Attention"


def valid_rating(rating: str = "rating") -> str:
    return f"coalesce({rating} IN ({', '.join(map(str, RATINGS))}), false)"


def valid_recommendation(flag: str = "recommended_ind") -> str:
    return f"coalesce({flag} IN (0, 1), false)"


def sentiment(rating: str = "rating") -> str:
    """Class of the rating with its fraction dropped (4.5 counts as 4, 0.5 as 0).

    Dropping the fraction is written as half-open ranges, so infinities and NaN need no cast.
    """
    return (
        f"CASE WHEN {rating} >= 1 AND {rating} < 3 THEN 'Negative' "
        f"WHEN {rating} >= 3 AND {rating} < 4 THEN 'Neutral' "
        f"WHEN {rating} >= 4 AND {rating} < 6 THEN 'Positive' ELSE '{UNKNOWN}' END"
    )


def recommendation_label(flag: str = "recommended_ind") -> str:
    """Label of the flag with its fraction dropped towards zero."""
    return (
        f"CASE WHEN {flag} >= 1 AND {flag} < 2 THEN 'Recommended' "
        f"WHEN {flag} > -1 AND {flag} < 1 THEN 'Not Recommended' ELSE '{UNKNOWN}' END"
    )


def age_band(age: str = "age") -> str:
    """Ten-year band; whatever is 29 or less falls in the first one."""
    return (
        f"CASE WHEN {age} IS NULL OR isnan({age}) THEN '{UNKNOWN}' "
        f"WHEN {age} <= 29 THEN '18-29' WHEN {age} <= 39 THEN '30-39' "
        f"WHEN {age} <= 49 THEN '40-49' WHEN {age} <= 59 THEN '50-59' ELSE '60+' END"
    )


def _bands(good: str, poor: str, poor_first: bool = False) -> str:
    cases = [f"WHEN {good} THEN '{GOOD}'", f"WHEN {poor} THEN '{POOR}'"]
    return f"CASE {' '.join(cases[::-1] if poor_first else cases)} ELSE '{FAIR}' END"


def performance_band(
    negative: str, recommendation: str, base_negative: str, base_recommendation: str
) -> str:
    """Poor when clearly more negative than the baseline; good when less so and well advocated."""
    gap = f"({negative} - {base_negative})"
    return _bands(
        f"{gap} <= -{STRONG_GAP} AND {recommendation} >= {base_recommendation}",
        f"{gap} >= {ATTENTION_GAP}",
        poor_first=True,
    )


def rating_cell(value: str, baseline: str) -> str:
    gap = f"({value} - {baseline})"
    return _bands(f"{gap} >= 0.1D", f"{gap} <= -0.2D")


def recommendation_cell(value: str, baseline: str) -> str:
    gap = f"({value} - {baseline})"
    return _bands(f"{gap} >= {STRONG_GAP}", f"{gap} <= -{ATTENTION_GAP}")


def negative_cell(value: str, baseline: str) -> str:
    gap = f"({value} - {baseline})"
    return _bands(f"{gap} < {STRONG_GAP}", f"{gap} >= {ATTENTION_GAP}")


def relative_band(value: str, baseline: str, high_is_good: bool = True) -> str:
    """Gap to the baseline as a part of the baseline (at least 1): +2 % good, -5 % poor."""
    unit = f"greatest(abs({baseline}), 1D)"
    gap = f"({value} - {baseline})" if high_is_good else f"(-({value} - {baseline}))"
    return _bands(f"{gap} >= 0.02D * {unit}", f"{gap} <= -0.05D * {unit}")


def absolute_band(value: str, baseline: str, high_is_good: bool = True) -> str:
    gap = f"({value} - {baseline})" if high_is_good else f"(-({value} - {baseline}))"
    return _bands(f"{gap} >= {STRONG_GAP}", f"{gap} <= -{ATTENTION_GAP}")


def missing_band(missing: str, rows: str) -> str:
    """None missing is good, a tenth of the rows or more is poor."""
    return _bands(f"{missing} = 0", f"double({missing}) / greatest({rows}, 1) >= 0.1D")


def completeness_band(percent: str) -> str:
    return _bands(f"{percent} >= 99", f"{percent} < 90")


def priority(remaining: str, overall: str, share: str) -> str:
    """High when both the rate is above the overall one and the share is material."""
    above, material = f"{remaining} > {overall}", f"{share} >= {MATERIAL_SHARE}"
    return (
        f"CASE WHEN {above} AND {material} THEN 'High' "
        f"WHEN {above} OR {material} THEN 'Medium' ELSE 'Low' END"
    )


def direction(change: str, higher_is_better: bool, tolerance: str = "1e-12D") -> str:
    """Whether a change is an improvement; within ``tolerance`` it is none."""
    better = f"{change} > 0" if higher_is_better else f"{change} < 0"
    return (
        f"CASE WHEN abs({change}) < {tolerance} THEN 'unchanged' "
        f"WHEN {better} THEN 'improved' ELSE 'deteriorated' END"
    )


def share_label(share: str) -> str:
    """Percent text for shares wide enough to be labelled (6 % and more)."""
    return f"CASE WHEN {share} >= 6 THEN format_string('%.1f%%', {share}) ELSE '' END"


def all_finite(*values: str) -> str:
    """True when no value is NULL, NaN or infinite."""
    return " AND ".join(f"({finite(v)}) IS NOT NULL" for v in values)

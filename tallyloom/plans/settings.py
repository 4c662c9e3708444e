"""Selections, limits and assumptions the queries use, shared with the SQL that checks them."""

from __future__ import annotations

from tallyloom.operators.scenario import Assumptions
from tallyloom.operators.validation import Expectation

# Minimum reviews and selections used by the queries.
MIN_CLASS, MIN_DEPARTMENT = 600, 200
CHOICES = {
    "divisions": ["ASIA", "EUROPE", "AMERICA"],
    "sentiments": ["Negative", "Positive"],
    "recommendations": ["Recommended"],
    "age_bands": ["30-39", "40-49", "60+"],
    "ratings": [1, 2, 5],
}
SWEEP = [
    Assumptions(0, 0, 0, 0, 0, "none"),
    Assumptions(name="default"),
    Assumptions(33, 67, 25, 40, 10, "careful"),
    Assumptions(100, 100, 50, 50, 100, "all"),
]
SAME_NAMES = [Assumptions(negative_reached=50), Assumptions(negative_reached=100)]
EXPECTED = [
    Expectation("total_records", "Total Reviews", 15000),
    Expectation("average_rating", "Average Rating", 3.0, 0.05, "rating"),
    Expectation("recommendation_rate", "Recommendation Rate", 82.24, 0.15, "percent"),
    Expectation("negative_rate", "Negative Rate", 40.0, 1.0, "percent"),
    Expectation("median_age", "Median Age", 45),
]

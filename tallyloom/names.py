"""Column names, label orders and other fixed values shared by every module.

A *raw* review table has the ten source columns below (snake case) plus a unique ``row_id``;
a *clean* table adds the derived columns. Both are ordinary DataFrames.
"""

from __future__ import annotations

ROW_ID = "row_id"

# Header of the source files -> column name used here.
SOURCE_COLUMNS = {
    "Clothing ID": "clothing_id",
    "Age": "age",
    "Title": "title",
    "Review Text": "review_text",
    "Rating": "rating",
    "Recommended IND": "recommended_ind",
    "Positive Feedback Count": "positive_feedback_count",
    "Division Name": "division_name",
    "Department Name": "department_name",
    "Class Name": "class_name",
}

# How the exported row index shows up in a header (a blank header cell is
# read as ``_c0`` by Spark).
INDEX_COLUMNS = ("Unnamed: 0", "", "_c0")

NUMERIC_COLUMNS = ("clothing_id", "age", "rating", "recommended_ind", "positive_feedback_count")
TEXT_COLUMNS = ("title", "review_text", "division_name", "department_name", "class_name")
TAXONOMY_COLUMNS = ("division_name", "department_name", "class_name")
REQUIRED_COLUMNS = tuple(SOURCE_COLUMNS.values())

DERIVED_COLUMNS = (
    "has_review_text",
    "has_title",
    "valid_rating",
    "valid_recommendation",
    "sentiment",
    "recommendation_label",
    "age_band",
    "review_length_words",
    "title_length_words",
    "is_duplicate_review_text",
)

# Optional column written at ingestion: digest of the normalised review text, so that
# duplicate detection reads 32 bytes per row instead of the text.
TEXT_KEY = "review_text_key"

# Optional column of a clean table: digest of the review text as it stands, taken before the
# duplicate flag is joined, so that counting repeated texts moves 32 bytes per row.
TEXT_SPELLING = "review_text_spelling"

# Placeholders and labels that appear in results.
TITLE_PLACEHOLDER = "Untitled Review"
TEXT_PLACEHOLDER = "No Review Text"
UNKNOWN = "Unknown"

SENTIMENTS = ("Negative", "Neutral", "Positive")
RECOMMENDATIONS = ("Not Recommended", "Recommended")
AGE_BANDS = ("18-29", "30-39", "40-49", "50-59", "60+")
RATINGS = (1, 2, 3, 4, 5)
PRIORITIES = ("High", "Medium", "Low")

# Cells that count as missing when a file is read.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns of a review list, with the shorter names used for display.
REVIEW_LIST = {
    "clothing_id": "clothing_id",
    "age": "age",
    "age_band": "age_band",
    "title": "title",
    "review_text": "review_text",
    "rating": "rating",
    "sentiment": "sentiment",
    "recommendation_label": "recommendation",
    "positive_feedback_count": "helpful_votes",
    "division_name": "division",
    "department_name": "department",
    "class_name": "class",
}

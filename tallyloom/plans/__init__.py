"""Named queries over the review tables and the SQL they are checked against."""

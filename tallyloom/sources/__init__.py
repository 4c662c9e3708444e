"""Reading, typing, checking and writing review tables."""

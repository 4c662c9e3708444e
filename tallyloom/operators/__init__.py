"""Analytical operators: functions from DataFrame to DataFrame, lazy and composable."""

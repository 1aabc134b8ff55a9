"""Operators: DataFrame -> DataFrame functions grouped by analysis family."""

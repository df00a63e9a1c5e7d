"""Operators: DataFrame -> DataFrame functions over the typed order table."""

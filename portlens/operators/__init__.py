"""Relational operators: DataFrame -> DataFrame transforms."""

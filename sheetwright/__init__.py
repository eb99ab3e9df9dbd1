"""Sheetwright: Spark jobs that lay photo collections out as contact sheets."""

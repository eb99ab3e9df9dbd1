"""Whole jobs, and the queries that the driver runs."""

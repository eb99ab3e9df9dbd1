"""Watched folders."""

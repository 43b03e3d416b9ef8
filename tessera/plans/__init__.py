"""Whole plans: index build, evaluation, caches, configuration, and the query catalogue."""

"""Relational operators: folds, joins, retrieval, metrics, pairs, loss, encoders."""

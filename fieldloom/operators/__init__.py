"""Metrics, windows, joins, pattern mining, extraction and evaluation over the canonical relations."""

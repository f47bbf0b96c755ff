"""Operators over event logs: enrichment, joins, detection, evidence, metrics."""

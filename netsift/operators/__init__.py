"""Detectors, joins and aggregations: DataFrame in, DataFrame out."""

"""Operators of a training-data pipeline: filters, joins, models and packing over text tables."""

"""Operators for preparing training text: counts, filters, joins, models and codecs over document tables."""

"""Training-data operators: mixing, scanning, filtering, dedup, joins, encoding."""

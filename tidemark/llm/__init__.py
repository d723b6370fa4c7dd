"""Operators that prepare training data: filtering, joins, scoring, sharding and packing."""

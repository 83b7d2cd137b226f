"""Tensor operators as projections, joins, aggregations and windows."""

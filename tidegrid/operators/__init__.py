"""Generic DataFrame operators: skew-safe grouping, joins, aggregates, windows, reshape, space, statistics."""

"""Relational operators: lines, rules, joins, aggregates, windows, rankings, sets."""

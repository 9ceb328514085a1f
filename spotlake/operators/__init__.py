"""Composable DataFrame transforms: columns, joins, aggregates, profiles, text."""

"""DataFrame operators: matching results, folding, joins and graph tables."""

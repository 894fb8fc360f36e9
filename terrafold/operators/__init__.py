"""Tag queries, spatial tests, joins and relationships."""

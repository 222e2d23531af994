"""Values, columns and aggregations."""

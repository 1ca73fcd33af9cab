"""Column builders and small aggregates that the operators share."""

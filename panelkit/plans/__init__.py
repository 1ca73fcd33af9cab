"""Whole workflows, and the queries of the driver contract with their SQL."""

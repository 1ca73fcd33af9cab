"""Panels that grow: incremental ingestion."""

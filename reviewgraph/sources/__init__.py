"""Schemas, table loading, staging and export."""

"""Readers, sinks and the catalog of tables."""

"""Readers, vendor mapping and connectors."""

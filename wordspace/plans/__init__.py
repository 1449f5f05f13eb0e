"""Whole jobs composed from operators, and the catalog of registered queries."""

"""Nodes, helpers and caches."""

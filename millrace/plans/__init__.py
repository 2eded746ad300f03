"""Queries: the registry and the relational workloads."""

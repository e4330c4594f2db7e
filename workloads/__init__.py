"""Workloads over the driver tables: derived inputs, queries and their SQL."""

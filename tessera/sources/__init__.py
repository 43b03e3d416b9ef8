"""Readers for the file formats of the workload."""

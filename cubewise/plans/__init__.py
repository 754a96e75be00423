"""Cube feed jobs, the binding to the source tables, and routes."""

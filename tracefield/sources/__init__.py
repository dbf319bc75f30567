"""Typed readers and writers."""

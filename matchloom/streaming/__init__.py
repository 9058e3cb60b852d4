"""Incremental processing of arriving files."""

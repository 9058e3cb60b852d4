"""Readers and writers over spark.read / df.write."""

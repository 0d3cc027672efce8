"""Companions of partitioned tables and vector search."""

"""Partitioned tables: declarations, manifests, storage and read-only overlays."""

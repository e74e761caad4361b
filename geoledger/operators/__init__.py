"""Spatial joins, linkage scores, components and entity assembly."""

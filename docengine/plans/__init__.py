"""Helpers for cutting lineage and choosing join strategies by measured size."""

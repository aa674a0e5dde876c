"""Batch and streaming analytics over legal-text corpora on PySpark."""

from lexspark.session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]

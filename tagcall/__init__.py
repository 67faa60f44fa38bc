"""Variant calling over molecule-tagged reads as PySpark DataFrame transformations."""

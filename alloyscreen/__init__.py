"""Alloy-candidate screening as Spark DataFrame transformations."""

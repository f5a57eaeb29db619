"""Whole jobs: screening, export, training."""

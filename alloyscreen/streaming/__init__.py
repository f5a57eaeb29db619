"""Outcome and candidate streams."""

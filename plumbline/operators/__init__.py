"""Ordered numeric series and their operators."""

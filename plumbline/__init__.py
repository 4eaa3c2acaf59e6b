"""Plumbline: ordered numeric series and performance-history analytics on Spark."""

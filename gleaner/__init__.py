"""Posting analytics on Spark: extraction, resolution, scoring, gates, lifecycle, monitoring."""

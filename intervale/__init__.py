"""Interval, sequence and document operators as Spark DataFrame transformations."""

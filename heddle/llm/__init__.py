"""Operators of a training-data pipeline, as Spark jobs on document tables."""

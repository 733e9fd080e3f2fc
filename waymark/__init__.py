"""Trajectory analytics on Spark: labelled state sequences per episode."""

__version__ = "0.1.0"

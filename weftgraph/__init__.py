"""Sequence-graph analytics as Spark DataFrame plans."""

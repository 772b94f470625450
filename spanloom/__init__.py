"""Span-annotation analytics expressed as Spark DataFrame plans."""

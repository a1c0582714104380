"""Readloom: alignment analytics expressed as Spark DataFrame plans."""

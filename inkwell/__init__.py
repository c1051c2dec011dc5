"""Inkwell: corpus preparation and text measurement as Spark DataFrame plans."""

"""Corpus preparation and analysis as Spark DataFrame plans."""

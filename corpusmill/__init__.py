"""Corpus and vocabulary analytics as Spark plans."""

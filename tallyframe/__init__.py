"""Spark-first analytics engine: register screening operators and text-corpus operators."""

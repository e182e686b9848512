"""Tessera: a Spark-first panel analytics engine."""

__version__ = "0.1.0"

"""Lodestone: trial analytics for coding agents on Apache Spark."""

__version__ = "0.1.0"

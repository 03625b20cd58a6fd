"""Ledgerloom: a Spark-native engine that turns filings into scored, auditable signals."""

__version__ = "0.1.0"

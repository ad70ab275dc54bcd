"""Operators for preparing training corpora on Spark."""

"""Banded-pay analytics on PySpark."""

"""Sieveline: screening and cleaning of large bibliographic exports on Spark."""

__version__ = "0.1.0"

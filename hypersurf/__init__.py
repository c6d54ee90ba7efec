"""Enumeration and analysis of cubical surfaces on Spark."""

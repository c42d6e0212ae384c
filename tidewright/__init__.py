"""Tidewright: event-to-lakehouse transforms on PySpark."""

"""Foliant: a PySpark-native engine for documents, books and parallel text."""

"""Tessera: a PySpark-native analytics and question-answering engine."""

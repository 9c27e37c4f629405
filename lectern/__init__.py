"""Lectern: Spark-native analysis of prose collections.

Documents are rows; text views, lines, blocks, sentences, tokens, findings and
metrics are DataFrames; rules are a small table.
"""

__version__ = "0.1.0"

"""Tessera: a PySpark-native analytics library.

Everything is declared with the DataFrame, SQL and Structured Streaming APIs;
Catalyst and adaptive execution choose the physical plan.
"""

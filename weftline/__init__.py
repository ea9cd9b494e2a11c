"""Weftline: experiment and data-flow analytics on PySpark DataFrames."""

"""Strandlake: a Spark-native engine for long-read transcript analytics.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
unless its size has a proven bound.  The subpackage ``llm`` is optional and
nothing else in the package imports it.
"""

__version__ = "0.1.0"

"""weftline: a Spark-first analytics engine for next-period purchase recommendation.

Every operator is a function from DataFrames to a lazy DataFrame; nothing is
collected on the driver unless a docstring names the bound.
"""

__version__ = "0.1.0"

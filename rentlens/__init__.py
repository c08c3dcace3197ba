"""Rental-listing analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns) and runs
through the DataFrame / SQL / MLlib / Structured Streaming APIs.
"""

__version__ = "0.1.0"

"""riskframe: code-risk questions over tables of many repositories, as Spark DataFrame operators.

Every operator takes and returns DataFrames. "Now" is always a parameter, never the wall clock.
"""

__version__ = "0.1.0"

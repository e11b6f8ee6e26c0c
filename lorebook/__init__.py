"""lorebook: a PySpark-native analytics engine for corpora of troubleshooting records.

DataFrames in, DataFrames out.  See README.md for the operator map.
"""

__version__ = "0.1.0"

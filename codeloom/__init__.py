"""Code-graph analytics on PySpark: relations of a source repository as DataFrames."""

__version__ = "0.2.0"

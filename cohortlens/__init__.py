"""Customer-behaviour analytics on Spark SQL and Spark ML."""

__version__ = "0.1.0"

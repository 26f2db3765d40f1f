"""weftline: a DataFrame-first data preparation and profiling engine for PySpark."""

__version__ = "0.1.0"

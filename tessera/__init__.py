"""tessera: an analytics engine expressed in PySpark DataFrames."""

__version__ = "0.1.0"

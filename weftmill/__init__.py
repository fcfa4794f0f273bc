"""weftmill: a Spark-first engine for building, cleaning and searching document collections."""

__version__ = "0.1.0"

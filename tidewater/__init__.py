"""tidewater: Spark-first data cleaning, profiling, table sync and validation."""

__version__ = "0.1.0"

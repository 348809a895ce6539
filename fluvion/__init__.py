"""Set-based Spark jobs for bitemporal environmental time series."""

__version__ = "0.1.0"

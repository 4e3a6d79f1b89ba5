"""gridspark: analytics on gridded, multi-member forecast data as Spark plans."""

__version__ = "0.1.0"

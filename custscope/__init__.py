"""Customer analytics as DataFrame operators on Spark."""

__version__ = "0.1.0"

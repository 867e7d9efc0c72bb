"""A PySpark-native engine for source analysis, event analytics and workflow queries."""

__version__ = "0.1.0"

"""pagewright: a PySpark-native engine for structured long-form documents."""

__version__ = "0.1.0"

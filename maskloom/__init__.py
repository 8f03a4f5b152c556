"""maskloom: a PySpark-native engine that finds, masks and audits personal data."""

__version__ = "0.1.0"

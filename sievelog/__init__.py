"""Security-log analytics on Spark: parse, featurise, score, alert and profile log tables and streams."""

__version__ = "0.1.0"

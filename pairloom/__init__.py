"""A DataFrame-native engine for maximum-cardinality matching on large unweighted graphs."""

__version__ = "0.1.0"

"""A Spark-native property-graph engine for source code and for relational data mapped to nodes and edges."""

__version__ = "0.1.0"

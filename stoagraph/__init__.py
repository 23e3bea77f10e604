"""stoagraph: a Spark-native engine that turns page and text tables into a knowledge graph and queries it."""

__version__ = "0.1.0"

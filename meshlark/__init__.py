"""Spark-native terrain, mesh, graph and evidence analytics."""

__version__ = "0.1.0"

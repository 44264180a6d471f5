"""Vellum: a Spark-first engine for note vaults, property graphs and text tables."""

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the workers by value, so that a cluster
# needs no installed copy of it (and never runs a stale one).
_cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

__version__ = "0.1.0"

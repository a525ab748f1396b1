"""Spark-native analytics over graphs of source code and similar data.

Functions that run in Python workers are shipped by value, so executors need
only PySpark and the listed libraries, not this package on their own path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

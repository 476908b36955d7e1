"""A Spark-native engine for indexing and querying two-dimensional rectangles.

Task functions and data sources are pickled by value, so executors need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

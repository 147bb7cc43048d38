"""Ranked retrieval over property graphs and text collections, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs
# no installed copy of it next to the Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

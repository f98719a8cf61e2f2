"""Spark-native analytics over partitioned message logs and the training runs that read them."""

import sys

from pyspark import cloudpickle

# Python tasks carry this package's functions with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

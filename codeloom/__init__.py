"""A Spark-native engine for questions about program structure."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

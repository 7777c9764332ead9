"""Spark-native analytics for pairwise-preference evaluation data.

Functions shipped to executors are pickled by value, so a job works whether or
not the executors can import this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

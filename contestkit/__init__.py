"""Time-safe analytics over head-to-head contests, on Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value: a cluster needs no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

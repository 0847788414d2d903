"""Transit analytics on Spark: cleaning, profiling, demand, routes, matching."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Entity-by-day panel analytics as composable Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# The Arrow UDFs travel with their helper functions, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native catalogue, tiling, embedding and analysis operators for image tiles."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the tasks: executors need NumPy, pandas and Arrow, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

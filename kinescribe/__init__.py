"""Spark-native engine that rebuilds timed captions from noisy text readings.

Python functions that run on executors are shipped by value, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])

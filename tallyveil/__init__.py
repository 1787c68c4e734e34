"""Spark operators for releasing, generating and analysing private synthetic tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Column functions travel to executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

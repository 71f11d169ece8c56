"""Operators for preparing training data."""

import sys

from pyspark import cloudpickle

# functions that run on executors are shipped by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

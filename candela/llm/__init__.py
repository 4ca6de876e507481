"""Operators of a training-data pipeline, one module each; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a worker
# needs no copy of the repository on its own path.
cloudpickle.register_pickle_by_value(sys.modules["candela"])

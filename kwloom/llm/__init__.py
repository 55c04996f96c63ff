"""Operators of a training-data pipeline; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# tasks get this package's code by value, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Quarterly bank-filing analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value with their job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

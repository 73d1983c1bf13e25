"""Spark-first analytics over job postings: sources, operators, plans and streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
# functions sent to Python workers travel by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Lectern: semi-structured catalogue analytics on Spark DataFrames.

The package is shipped to Python workers by value, so a job needs no copy of it
on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics over fused ledger and network observations.

Every operator is a function from DataFrames to a DataFrame; Catalyst picks the physical plan.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

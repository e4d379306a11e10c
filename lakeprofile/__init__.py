"""Inventory, profiling and loading of data-lake files as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

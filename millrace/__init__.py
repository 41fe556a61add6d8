"""millrace: a Spark-first library for analytics and text-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this library travel to the executors by value: those need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

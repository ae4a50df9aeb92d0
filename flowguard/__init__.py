"""Network-traffic anomaly analytics as Spark DataFrame, Spark ML and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

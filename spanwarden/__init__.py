"""Security and corpus analytics over Spark tables."""

import sys

from pyspark import cloudpickle

# Functions of this library travel to the executors with the plan, which need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

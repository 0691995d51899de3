"""graphquarry: a Spark-native engine for source-code property graphs."""

import sys

from pyspark import cloudpickle

#: Python workers on executors get this library's functions by value, so a job needs no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

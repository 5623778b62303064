"""Spark-native record linkage: text features, retrieval, scoring, decisions and checks as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the plan, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

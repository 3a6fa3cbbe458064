"""Spark-native document retrieval, layout chunking and cited question answering."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

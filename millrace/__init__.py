"""Spark jobs that prepare documents and schemas for retrieval."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

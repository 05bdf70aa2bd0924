"""Spark-native curation, deduplication and detector evaluation."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

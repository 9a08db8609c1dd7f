"""Multilingual corpus, vocabulary and tagging analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions used inside tasks travel with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

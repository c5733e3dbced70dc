"""Metadata enrichment, text vectors, similarity graphs and clustering on Spark.

Every operator takes and returns PySpark DataFrames keyed by a record id.
"""

import sys

from pyspark import cloudpickle

# Ship the Arrow kernels to executors by value, so a job needs no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

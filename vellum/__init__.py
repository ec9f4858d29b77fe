"""Spark-first engine that audits, repairs and prepares documents at corpus scale."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors whole, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

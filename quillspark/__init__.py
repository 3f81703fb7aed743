"""Spark jobs for API-documentation catalogs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

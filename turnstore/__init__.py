"""Long-term conversation memory as Spark tables: write, search, evaluate."""

import sys

from pyspark import cloudpickle

from turnstore.settings import SearchSettings

# Task functions travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SearchSettings"]

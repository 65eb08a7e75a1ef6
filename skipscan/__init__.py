"""Spark-first engine: file-skipping indexes, exact counts, hunts, detection rules."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need public packages alone, and no copy of this one.
register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing training data; nothing else in the package imports this.

Functions sent to executors are pickled by value, so executors need only
public packages and no copy of this repository.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

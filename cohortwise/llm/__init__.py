"""Operators for training-data pipelines, and their registered queries.

Their functions travel to the executors by value, so that a session need
not ship this package to them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for large-scale training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# the functions of this package travel with the tasks, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .queries import ORACLES, QUERIES  # noqa: E402,F401

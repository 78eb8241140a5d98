"""Operators for preparing training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

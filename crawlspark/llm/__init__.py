"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed: what they run is sent along by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

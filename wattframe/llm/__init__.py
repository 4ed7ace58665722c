"""Operators for preparing training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get the code of this package with the function they run, so no worker needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

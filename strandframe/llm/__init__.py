"""Operators for preparing language-model training data. Nothing else in the library imports this.

Functions that run on executors travel by value, so executors needn't have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

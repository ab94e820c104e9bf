"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage; it can be removed whole.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

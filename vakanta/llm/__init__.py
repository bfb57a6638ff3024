"""Operators for preparing large text corpora; nothing else in the library imports this subpackage.

Task functions are shipped by value, so that workers need not find the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing text corpora. Nothing else in the library imports this package.

Functions that run in Python workers are sent by value, so workers need not have the
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing training text.

Python functions of this subpackage are shipped to the workers by value, so that a cluster needs no
copy of the package on every machine.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Its functions are shipped
to the executors by value, so workers need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

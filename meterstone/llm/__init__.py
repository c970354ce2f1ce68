"""Operators for preparing large training corpora. Each module has one operator and can be used alone.

The functions that run inside tasks travel with the job instead of being imported on the executors, so executors
need the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

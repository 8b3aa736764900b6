"""Quern: catalog search, vector search and corpus preparation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions go to the workers by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

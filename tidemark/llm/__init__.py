"""Operators of a training-data pipeline over tables of documents, pages and vectors.

Nothing else in the library imports this package.  Its functions run inside
tasks, so they are pickled by value: executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
